"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear (logistic) models over hashed features of a text: its words and the
beginnings of its words (STEMS bytes), each once, so that forms of a word unseen in the fit still count. Each model also
takes the probabilities of the categories before it. While fitting, those are out-of-fold predictions, so that a later model
meets earlier probabilities as uncertain as they will be on new texts. A model takes the features that differ significantly
between the labels and fits all of them together under an L2 penalty. The last category's threshold is the one of the greatest F1
over its own out-of-fold predictions, and no less than the label's share.

The supplied labels know one kind of toxicity; the chain's first category, low quality, is no toxicity itself but tells the
second model about junk, whose words prove less. The fit takes a bounded sample: of at most FIT_DOCS labelled doc_ids, one
text of at most FIT_BYTES bytes each, of near copies one. The fold whose crc32(doc_id as text) mod 4 is 2 is never learned
from, so its labels tell what the chain is worth.

Scoring is one pass without a shuffle. Defined cases: null and empty texts have no words and get the models' base rates;
labels that are null or not 0 or 1 are not learned from; of several labels of a doc_id the greater counts, of several texts
that with the least digest; without labels every probability is 0.5; repeated rows are scored alike; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, chunks, _LOWER, materialize, mix, read, rolling, shingles, span_hash, texts, tidy
from .quality_crf import held_out

FIT_DOCS, FIT_BYTES = 10_000, 1 << 16
#: Categories in chain order: name, and the SQL expression of its 0/1 label over the labels table.
CHAIN = (("low_quality", "1 - quality"), ("toxic", "toxic"))
FOLDS = 5
#: Bytes of word beginnings that are features of their own.
STEMS = (4, 5, 6, 7, 8)
#: Standard errors between the labels that make a feature significant, texts it must be in, and features of a model at most.
SIGNIFICANT, LEAST, MAX_FEATURES = 4.0, 3, 4096
PENALTY = 1.0
#: Where labels of one kind only tell nothing about a threshold.
THRESHOLD = 0.5

_TERM = np.zeros(256, bool)
_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _term_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of the runs of letters and digits; they never cross texts."""
    inside = _TERM[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.append(False, inside[:-1])[: len(data)]
    after = np.append(inside[1:], False)[: len(data)]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    return start, np.flatnonzero(inside & (~after | edge[1:])) + 1


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of letters and digits, A-Z lower-cased, and the first of each text."""
    start, end = _term_spans(data, offsets)
    return span_hash(rolling(_LOWER[data]), start, end), np.searchsorted(start, offsets)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature hash, text index) of the words and word beginnings of a run of texts."""
    lower = _LOWER[data]
    start, end = _term_spans(data, offsets)
    prefix = rolling(lower)
    doc = np.searchsorted(offsets, start, "right") - 1
    found, where = [span_hash(prefix, start, end)], [doc]
    for k in STEMS:
        long = end - start > k
        found.append(span_hash(prefix, start[long], start[long] + k) ^ np.uint64(0x5851F42D4C957F2D))
        where.append(doc[long])
    return np.concatenate(found), np.concatenate(where)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _minimise(loss, w: np.ndarray, steps: int = 80, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS with halving steps; ``loss`` gives value and gradient."""
    value, grad = loss(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, kept = grad.copy(), []
        for s, y in reversed(past):
            a = s @ q / (y @ s)
            kept.append(a)
            q -= a * y
        if past:
            q *= past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1])
        for (s, y), a in zip(past, reversed(kept), strict=True):
            q += s * (a - y @ q / (y @ s))
        step = 1.0 if past else 1 / max(1e-9, np.abs(grad).sum())
        new, (value2, grad2) = w - step * q, loss(w - step * q)
        while value2 > value - 1e-4 * step * (grad @ q) and step > 1e-8:
            step /= 2
            new, (value2, grad2) = w - step * q, loss(w - step * q)
        if (new - w) @ (grad2 - grad) > 1e-12:
            past = [*past, (new - w, grad2 - grad)][-memory:]
        settled = abs(value - value2) < 1e-8 * max(1.0, abs(value))
        w, value, grad = new, value2, grad2
        if settled:
            break
    return w


def _logit(p: np.ndarray) -> np.ndarray:
    return np.log(np.clip(p, 1e-4, 1 - 1e-4) / np.clip(1 - p, 1e-4, 1))


class Linear:
    """Logistic model over features (sorted hashes) and the earlier categories' log-odds; the last weight is the constant."""

    def __init__(self, chosen: np.ndarray, weights: np.ndarray):
        self.chosen, self.weights = chosen, weights

    def predict(self, h: np.ndarray, doc: np.ndarray, n: int, earlier: np.ndarray) -> np.ndarray:
        """h, doc: pairs of a feature and a text that has it, repeated or not."""
        k = len(self.chosen)
        z = _logit(earlier) @ self.weights[k:-1] + self.weights[-1]
        if k and len(h):
            at = np.minimum(np.searchsorted(self.chosen, h), k - 1)
            hit = self.chosen[at] == h
            once = np.unique(doc[hit] * k + at[hit])
            z = z + np.bincount(once // k, self.weights[once % k], n)
        return _sigmoid(z)


def fit_linear(h: np.ndarray, doc: np.ndarray, earlier: np.ndarray, y: np.ndarray) -> Linear:
    """A model of y. h, doc: distinct pairs of a feature and a text that has it."""
    n, share = len(y), y.mean()
    value, feature = np.unique(h, return_inverse=True)
    often, good = np.bincount(feature, minlength=len(value)), np.bincount(feature, y[doc], len(value))
    apart = np.abs(good - often * share) / np.sqrt(np.maximum(often * share * (1 - share), 1e-9))
    best = np.flatnonzero((often >= LEAST) & (apart >= SIGNIFICANT))
    best = np.sort(best[np.argsort(-apart[best], kind="stable")][:MAX_FEATURES])
    place = np.full(len(value), -1)
    place[best] = np.arange(len(best))
    hit = place[feature] >= 0
    column, row, k, odds = place[feature[hit]], doc[hit], len(best), _logit(earlier)

    def loss(w):
        z = np.bincount(row, w[column], n) + odds @ w[k:-1] + w[-1]
        r = _sigmoid(z) - y
        grad = np.concatenate([np.bincount(column, r[row], k), odds.T @ r, [r.sum()]])
        grad[:-1] += PENALTY * w[:-1]
        return np.sum(np.logaddexp(0, z) - y * z) + PENALTY / 2 * np.sum(w[:-1] ** 2), grad

    return Linear(value[best], _minimise(loss, np.zeros(k + odds.shape[1] + 1)))


class Chain:
    def __init__(self, names: tuple[str, ...], models: list[Linear], threshold: float = THRESHOLD):
        self.names, self.models, self.threshold = names, models, threshold

    def predict(self, h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """Probabilities (texts x categories)."""
        out = np.zeros((n, 0))
        for m in self.models:
            out = np.hstack([out, m.predict(h, doc, n, out)[:, None]])
        return out


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold of the greatest F1 of probabilities against labels, half way down to the next probability, but no less than the share of the label; THRESHOLD if all labels agree."""
    if not 0 < y.sum() < len(y):
        return THRESHOLD
    order = np.argsort(-p, kind="stable")
    cut, right = p[order], np.cumsum(y[order])
    ends = np.flatnonzero(np.append(cut[1:] < cut[:-1], True))
    f1 = 2 * right[ends] / (ends + 1 + y.sum())
    at = ends[np.argmax(f1)]
    return max(float((cut[at] + (cut[at + 1] if at + 1 < len(cut) else 0.0)) / 2), min(float(y.mean()), float(cut[at])))


def learn(h: np.ndarray, doc: np.ndarray, y: np.ndarray, fold: np.ndarray, names: tuple[str, ...]) -> Chain:
    """The chain for labels y (texts x categories); earlier categories reach later models out of fold, and so does the last one its threshold."""
    models, earlier = [], np.zeros((len(y), 0))
    for k in range(len(names)):
        models.append(fit_linear(h, doc, earlier, y[:, k]))
        apart = np.full(len(y), y[:, k].mean())
        for f in range(FOLDS):
            rest = np.flatnonzero(fold != f)
            if not len(rest) or len(rest) == len(y):
                continue
            place = np.full(len(y), -1)
            place[rest] = np.arange(len(rest))
            at = place[doc] >= 0
            model = fit_linear(h[at], place[doc[at]], earlier[rest], y[rest, k])
            apart[fold == f] = model.predict(h, doc, len(y), earlier)[fold == f]
        earlier = np.hstack([earlier, apart[:, None]])
    return Chain(names, models, best_threshold(earlier[:, -1], y[:, -1]))


def fit_chain(docs: DataFrame, labels: DataFrame, chain: tuple[tuple[str, str], ...] = CHAIN) -> Chain:
    names = tuple(n for n, _ in chain)
    wanted = labels.where(~held_out()).select("doc_id", *(F.expr(e).cast("int").alias(n) for n, e in chain)).where("doc_id is not null and " + " and ".join(f"{n} in (0, 1)" for n in names))
    wanted = wanted.groupBy("doc_id").agg(*(F.max(n).alias(n) for n in names)).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(FIT_DOCS)
    sample = docs.select("doc_id", "text").where(F.octet_length("text") <= FIT_BYTES).join(F.broadcast(wanted), "doc_id")
    sample = sample.groupBy("doc_id", *names).agg(F.min_by("text", F.md5("text")).alias("text")).select("doc_id", "text", *names)
    kind = "doc_id long, labels binary, sketch binary, found binary"
    schema = arrow_schema(kind, docs.sparkSession)

    def describe(batches):
        for batch in batches:
            y = np.stack([np.asarray(batch.column(k)).astype(np.int8) for k in range(2, 2 + len(names))], 1)
            for i, j, data, offsets in chunks(texts(batch.column(1))):
                s, at = shingles(*terms(data, offsets), 5)
                sketch = np.zeros((j - i, 4), np.uint64)
                for k in range(4):
                    full = np.flatnonzero(np.diff(at))
                    if len(full):
                        sketch[full, k] = np.minimum.reduceat(mix(s ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) % 2**64)), at[:-1][full])
                h, doc = features(data, offsets)
                order = np.argsort(doc, kind="stable")
                cut = np.searchsorted(doc[order], np.arange(j - i + 1))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).cast(pa.int64()), pa.array([r.tobytes() for r in y[i:j]], pa.binary()), pa.array([r.tobytes() for r in sketch], pa.binary()), pa.array([np.unique(h[order[a:b]]).tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary())], schema=schema)

    described = materialize(sample.mapInArrow(tidy(describe), kind), "labelled-texts")
    rows = sorted(described.select("doc_id", "labels", "sketch").collect(), key=lambda r: r["doc_id"])
    seen: set[tuple[int, int]] = set()
    ids, ys = [], []
    for r in rows:
        marks = list(enumerate(np.frombuffer(r["sketch"], np.uint64).tolist()))
        if any(m in seen for m in marks):
            continue  # a near copy of a text that teaches already
        seen.update(m for m in marks if m[1])
        ids.append(r["doc_id"])
        ys.append(np.frombuffer(r["labels"], np.int8))
    if not ys:
        return Chain(names, [Linear(np.zeros(0, np.uint64), np.zeros(k + 1)) for k in range(len(names))])
    y = np.stack(ys).astype(np.float64)
    fold = (mix(np.array(ids, np.int64).view(np.uint64)) % np.uint64(FOLDS)).astype(np.int64)
    chosen = candidates(described, ids, y, fold)
    place = {d: i for i, d in enumerate(ids)}
    sent = docs.sparkSession.sparkContext.broadcast(chosen)
    held, pair = "doc_id long, found binary", arrow_schema("doc_id long, found binary", docs.sparkSession)

    def only_chosen(batches):
        for batch in batches:
            found = [h[np.isin(h, sent.value)].tobytes() for h in (np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], schema=pair)

    kept = [(place[r["doc_id"]], np.frombuffer(r["found"], np.uint64)) for r in described.select("doc_id", "found").mapInArrow(tidy(only_chosen), held).collect() if r["doc_id"] in place]
    kept.sort(key=lambda x: x[0])
    doc = np.repeat([i for i, _ in kept], [len(x) for _, x in kept]).astype(np.int64)
    return learn(np.concatenate([x for _, x in kept]), doc, y, fold, names)


def candidates(described: DataFrame, ids: list[int], y: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """Sorted hashes of the features that any model of the chain may choose: significant in all texts, or in those beyond some fold.

    described(doc_id, found): features are counted by fold and label where they are; the driver gets no more than
    MAX_FEATURES a category and fit.
    """
    k = y.shape[1]
    kind = "h long, fold int, " + ", ".join(f"y{j} int" for j in range(k))
    schema = arrow_schema(kind, described.sparkSession)
    sent = described.sparkSession.sparkContext.broadcast({d: (int(f), *map(int, row)) for d, f, row in zip(ids, fold, y, strict=True)})

    def spread(batches):
        for batch in batches:
            known = [(sent.value[d], np.frombuffer(x, np.int64)) for d, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if d in sent.value]
            if known:
                labels = np.repeat(np.array([m for m, _ in known], np.int32), [len(x) for _, x in known], axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x for _, x in known])), *(pa.array(labels[:, j].copy()) for j in range(k + 1))], schema=schema)

    rows = described.select("doc_id", "found").mapInArrow(tidy(spread), kind)
    counts = [F.count_if(F.col("fold") == f).alias(f"n_{f}") for f in range(FOLDS)]
    counts += [F.count_if((F.col("fold") == f) & (F.col(f"y{j}") == 1)).alias(f"p_{j}_{f}") for j in range(k) for f in range(FOLDS)]
    held = rows.groupBy("h").agg(*counts)
    apart = []
    for j in range(k):
        for left_out in (None, *range(FOLDS)):
            inside = fold != left_out if left_out is not None else np.ones(len(fold), bool)
            share = float(y[inside, j].mean()) if inside.any() else 0.0
            if not 0 < share < 1:
                continue
            n = sum(F.col(f"n_{f}") for f in range(FOLDS) if f != left_out)
            p = sum(F.col(f"p_{j}_{f}") for f in range(FOLDS) if f != left_out)
            apart.append(F.when(n >= LEAST, F.abs(p - n * share) / F.sqrt(n * (share * (1 - share)))))
    if not apart:
        return np.zeros(0, np.uint64)
    best = held.select("h", F.greatest(*apart, F.lit(0.0)).alias("z")).where(F.col("z") >= SIGNIFICANT * 0.999).orderBy(F.desc("z"), "h").limit(MAX_FEATURES * k * (FOLDS + 1)).select("h").collect()
    return np.sort(np.array([r["h"] for r in best], np.int64).view(np.uint64))


def predict(docs: DataFrame, chain: Chain, threshold: float | None = None) -> DataFrame:
    """doc_id, a probability p_<category> for each category, and the last category as a boolean (by default from the chain's own threshold on)."""
    threshold = chain.threshold if threshold is None else threshold
    kind = "doc_id long, " + ", ".join(f"p_{n} double" for n in chain.names) + f", {chain.names[-1]} boolean"
    schema = arrow_schema(kind, docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(chain)

    def score(batches):
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            for i, j, data, offsets in chunks(texts(batch.column(1))):
                p = sent.value.predict(*features(data, offsets), j - i)
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), *(pa.array(p[:, k].copy()) for k in range(p.shape[1])), pa.array(p[:, -1] >= threshold)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(tidy(score), kind)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return predict(docs, fit_chain(docs, read(spark, sf_dir, "labels")))
