"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad. A line's features describe its bytes and words and those of the lines before and after
it. The field is fitted (full-batch Adam on the exact likelihood) on the lines of a bounded sample of labelled documents,
each line carrying its document's label; FIT_DOCS doc_ids with one text of at most FIT_BYTES bytes and FIT_LINES lines each
bound the sample. Scoring is one
pass over the text without any shuffle: forward-backward marginals of all lines of a text, weighted by the lines' lengths,
average into the document's score.

Defined cases: null and empty texts are one empty line and get that line's score; a null doc_id is never held out; labels
other than 0 and 1, and null ones, are not learned from; of several labels of a doc_id the greater counts, of several texts
that with the least digest; without any label every score is 0.5 by an all-zero field; repeated
rows are scored alike; an empty table gives an empty result; extra columns are ignored or pass through ``stage``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, chunks, materialize, read, texts, tidy, words

FIT_DOCS, FIT_BYTES, FIT_LINES = 4000, 1 << 16, 2000
#: Lines of all these texts together: some 400 MB of the driver.
ALL_LINES = 250_000
HELD_OUT_REMAINDER, FOLDS = 2, 4
THRESHOLD = 0.7
STEPS, RATE, PENALTY = 250, 0.1, 1e-3


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD_OUT_REMAINDER, F.lit(False))


def _flags(*chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for s in chars for c in s]] = True
    return out


_CLASSES = [
    _flags("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    _flags("abcdefghijklmnopqrstuvwxyz"),
    _flags("0123456789"),
    _flags("#*$%&<>"),
    _flags("|"),
    _flags("!?"),
    _flags(".,;:"),
    _flags("@/\\_=+~^{}[]()"),
]
N_OWN = len(_CLASSES) + 7


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line with those of its neighbours, first line of each text, length of each line + 1)."""
    breaks = np.flatnonzero(data == 10)
    # a line starts at each text's start and after each line feed of that text
    starts = np.concatenate([offsets[:-1], breaks + 1])
    owner = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, "right") - 1])
    order = np.lexsort((starts, owner))
    starts, owner = starts[order], owner[order]
    last = np.append(owner[1:] != owner[:-1], True)
    ends = np.where(last, offsets[owner + 1], np.append(starts[1:], 0) - 1)
    length = (ends - starts).astype(np.float64)

    def within(flag: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flag)])
        return (total[ends] - total[starts]).astype(np.float64)

    w, first_word, at = words(data, offsets, lower=False)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first_word))
    word_at = np.zeros(len(data), bool)
    word_at[at] = True
    same = np.zeros(len(data), bool)
    for k in (1, 2):  # a word of the text's, not of the line's, last two
        same[at[k:][(w[k:] == w[:-k]) & (text[k:] == text[:-k])]] = True
    n_words = np.maximum(within(word_at), 1)
    size = np.maximum(length, 1)
    own = [within(c[data]) / size for c in _CLASSES]
    first = data[np.minimum(starts, max(0, len(data) - 1))] if len(data) else np.zeros(len(starts), np.uint8)
    final = data[np.maximum(ends - 1, 0)] if len(data) else np.zeros(len(starts), np.uint8)
    full = length > 0
    own += [within(same) / n_words, np.log1p(length) / 8, np.log1p(n_words) / 6, np.minimum(length / n_words, 30) / 10, full & _CLASSES[6][final], full & _CLASSES[0][first], ~full]
    x = np.stack([np.asarray(c, np.float64) for c in own], 1)
    x[:, : len(_CLASSES)] *= 4
    before, after = np.zeros_like(x), np.zeros_like(x)
    inner = owner[1:] == owner[:-1]
    before[1:][inner] = x[:-1][inner]
    after[:-1][inner] = x[1:][inner]
    ones = np.ones((len(x), 1))
    return np.hstack([x, before, after, ones]), np.searchsorted(owner, np.arange(len(offsets))), length + 1


N_ALL = 3 * N_OWN + 1


class Field:
    """Binary linear-chain field: emission weights of label 1 against 0, and transition weights [from, to]."""

    def __init__(self, weights: np.ndarray | None = None, moves: np.ndarray | None = None):
        self.weights = np.zeros(N_ALL) if weights is None else weights
        self.moves = np.zeros((2, 2)) if moves is None else moves

    def messages(self, e: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward and backward log-odds of each line; all texts advance together, longest first."""
        count = np.diff(first)
        order = np.argsort(-count, kind="stable")
        start, count = first[:-1][order], count[order]
        m, f, b = self.moves, e.copy(), np.zeros_like(e)
        for t in range(1, int(count[0]) if len(count) else 0):
            at = start[: int(np.searchsorted(-count, -t, "left"))] + t
            r = f[at - 1]
            f[at] += np.logaddexp(r + m[1, 1], m[0, 1]) - np.logaddexp(r + m[1, 0], m[0, 0])
        for t in range(1, int(count[0]) if len(count) else 0):
            k = int(np.searchsorted(-count, -t, "left"))
            at = start[:k] + count[:k] - 1 - t
            r = b[at + 1] + e[at + 1]
            b[at] = np.logaddexp(r + m[1, 1], m[1, 0]) - np.logaddexp(r + m[0, 1], m[0, 0])
        return f, b

    def marginals(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        f, b = self.messages(x @ self.weights, first)
        return 1 / (1 + np.exp(-np.clip(f + b, -500, 500)))

    def fit(self, x: np.ndarray, first: np.ndarray, labels: np.ndarray) -> Field:
        """labels: of each text's lines. Minimises the mean negative log-likelihood per text plus an L2 penalty."""
        n = len(labels)
        y = np.repeat(labels.astype(np.float64), np.diff(first))
        inner = np.ones(len(x), bool)
        inner[first[1:][first[1:] > 0] - 1] = False
        left = np.flatnonzero(inner)
        gold_moves = np.zeros((2, 2))
        for a in (0, 1):
            gold_moves[a, a] = (y[left] == a).sum()
        state = [np.zeros(N_ALL + 4), np.zeros(N_ALL + 4)]
        for step in range(1, STEPS + 1):
            e = x @ self.weights
            f, b = self.messages(e, first)
            p = 1 / (1 + np.exp(-np.clip(f + b, -500, 500)))
            r = (b + e)[left + 1]
            logs = np.stack([np.zeros_like(r) + self.moves[0, 0], r + self.moves[0, 1], f[left] + self.moves[1, 0], f[left] + r + self.moves[1, 1]])
            joint = np.exp(logs - logs.max(0))
            joint = (joint / joint.sum(0)).sum(1).reshape(2, 2)
            grad = np.concatenate([x.T @ (p - y) / n + PENALTY * self.weights, ((joint - gold_moves) / n + PENALTY * self.moves).ravel()])
            state = [0.9 * state[0] + 0.1 * grad, 0.99 * state[1] + 0.01 * grad**2]
            move = RATE * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)
            self.weights = self.weights - move[:N_ALL]
            self.moves = self.moves - move[N_ALL:].reshape(2, 2)
        return self


def fit_field(docs: DataFrame, labels: DataFrame) -> Field:
    """A field fitted on at most FIT_DOCS labelled documents outside the held-out fold, chosen by a digest of doc_id."""
    chosen = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    chosen = chosen.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(FIT_DOCS)
    short = (F.octet_length("text") <= FIT_BYTES) & (F.regexp_count("text", F.lit("\n")) < FIT_LINES)
    sample = docs.select("doc_id", "text").where(short).join(F.broadcast(chosen), "doc_id")
    sample = sample.groupBy("doc_id", "quality").agg(F.min_by("text", F.md5("text")).alias("text")).select("doc_id", "text", "quality")
    sample = materialize(sample, "labelled-texts")
    # In the order of the digests, texts are taken until their lines are ALL_LINES: what the driver fits is bounded, whatever the texts.
    sizes = sample.select("doc_id", F.md5(F.col("doc_id").cast("string")).alias("h"), (F.regexp_count("text", F.lit("\n")) + 1).alias("n")).collect()
    total, last = 0, None
    for r in sorted(sizes, key=lambda r: (r["h"], r["doc_id"])):
        total += r["n"]
        if total > ALL_LINES:
            last = r["h"]
            break
    if last is not None:
        sample = sample.where(F.md5(F.col("doc_id").cast("string")) < last)
    kind = "quality int, lines int, x binary"
    schema = arrow_schema(kind, docs.sparkSession)

    def describe(batches):
        for batch in batches:
            labels_here = np.asarray(batch.column(2))
            for i, j, data, offsets in chunks(texts(batch.column(1))):
                x, first, _ = line_features(data, offsets)
                x = x[:, :N_OWN].astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array(labels_here[i:j].astype(np.int32)), pa.array(np.diff(first).astype(np.int32)), pa.array([x[a:b].tobytes() for a, b in zip(first, first[1:], strict=False)], pa.binary())], schema=schema)

    found = sample.mapInArrow(tidy(describe), kind).collect()
    if not found:
        return Field()
    # repeated texts teach once
    found = sorted({(bytes(r["x"]), r["quality"]) for r in found})
    own = np.concatenate([np.frombuffer(x, np.float32).reshape(-1, N_OWN) for x, _ in found]).astype(np.float64)
    count = np.array([len(x) // (4 * N_OWN) for x, _ in found])
    first = np.concatenate([[0], np.cumsum(count)])
    owner = np.repeat(np.arange(len(count)), count)
    before, after = np.zeros_like(own), np.zeros_like(own)
    inner = owner[1:] == owner[:-1]
    before[1:][inner] = own[:-1][inner]
    after[:-1][inner] = own[1:][inner]
    return Field().fit(np.hstack([own, before, after, np.ones((len(own), 1))]), first, np.array([q for _, q in found]))


def scores(field: Field, column: pa.Array) -> np.ndarray:
    """Length-weighted mean of the line marginals of each text."""
    out = np.zeros(len(column))
    for i, j, data, offsets in chunks(column):
        x, first, length = line_features(data, offsets)
        p = field.marginals(x, first)
        out[i:j] = np.add.reduceat(p * length, first[:-1]) / np.add.reduceat(length, first[:-1])
    return np.clip(out, 0, 1)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    field = spark.sparkContext.broadcast(fit_field(docs, read(spark, sf_dir, "labels")))
    kind = "doc_id long, held_out boolean, score double, predicted int"
    schema = arrow_schema(kind, spark)

    def score(batches):
        for batch in batches:
            s = scores(field.value, texts(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], schema=schema)

    return docs.withColumn("held_out", held_out()).mapInArrow(tidy(score), kind)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents scored below THRESHOLD go; labels come from the tables beside the documents."""
    field = spark.sparkContext.broadcast(fit_field(docs, read(spark, sf_dir, "labels")))
    at = docs.columns.index("text")

    def keep(batches):
        for batch in batches:
            yield batch.filter(pa.array(scores(field.value, texts(batch.column(at))) >= THRESHOLD))

    return docs.mapInArrow(tidy(keep), docs.schema)
