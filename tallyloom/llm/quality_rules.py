"""Quality rules: base counts, then a hashed n-gram log-likelihood ratio of trusted against raw text.

Two multinomials over hashed byte 4-grams are counted: one over all documents, one over those that labels mark as of good
quality (the trusted target). A document's ratio is the mean over its n-grams of log(p_target / p_raw); it is kept if no
base rule fails and the ratio reaches KEEP_FROM. Counting and scoring are one pass over the text each; a task sends one
row for each of the 2 ** HASH_BITS slots at most, and the driver gets one row a slot, whatever the input.

Defined cases: null texts have no words and fail the base rules; texts under four bytes have no n-gram and ratio 0;
repeated rows count and are judged one by one; with no trusted document the ratio is 0 everywhere; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, chunks, materialize, read, rolling, small_join, _SPACE, span_hash, texts, tidy, words

N = 4
HASH_BITS = 16
SMOOTHING = 0.5
KEEP_FROM = -0.25
MIN_WORDS, WINDOW, REPEAT_PERCENT = 20, 8, 30
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def slots(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash slots of all byte n-grams and the first n-gram of each text; n-grams never cross texts."""
    if len(data) < N:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    d = data.astype(np.uint32)
    g = d[:-3] | (d[1:-2] << np.uint32(8)) | (d[2:-1] << np.uint32(16)) | (d[3:] << np.uint32(24))
    g = (g * np.uint32(2654435761)) >> np.uint32(32 - HASH_BITS)
    place = np.arange(len(g))
    inside = place + N <= np.repeat(offsets[1:], np.diff(offsets))[: len(g)]
    return g[inside].astype(np.int64), np.searchsorted(place[inside], offsets)


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of each text of a run."""
    texts_n = len(offsets) - 1

    def within(flag):
        total = np.concatenate([[0], np.cumsum(flag)])
        return total[offsets[1:]] - total[offsets[:-1]]

    w, first, at = words(data, offsets, lower=False)
    out = {"n_words": np.diff(first), "word_chars": within(~_SPACE[data] & ((data & 0xC0) != 0x80)), "n_symbols": within(_SYMBOL[data])}

    breaks = np.flatnonzero(data == 10)
    starts = np.concatenate([offsets[:-1], breaks + 1])
    owner = np.concatenate([np.arange(texts_n), np.searchsorted(offsets, breaks, "right") - 1])
    order = np.lexsort((starts, owner))
    starts, owner = starts[order], owner[order]
    last = np.append(owner[1:] != owner[:-1], True)[: len(owner)]
    ends = np.where(last, offsets[owner + 1], np.append(starts[1:], 0) - 1)
    worded = np.searchsorted(at, ends) > np.searchsorted(at, starts)
    h = span_hash(rolling(data), starts, ends)[worded]
    o = owner[worded]
    order = np.lexsort((h, o))
    again = np.zeros(len(h), bool)
    again[1:] = (h[order][1:] == h[order][:-1]) & (o[order][1:] == o[order][:-1])
    out["n_dup_lines"] = np.bincount(o[order][again], minlength=texts_n)

    repeat = np.zeros(len(w) + 1, np.int64)
    if len(w) >= WINDOW:
        mult = np.uint64(0xFF51AFD7ED558CCD)
        h = np.zeros(len(w) - WINDOW + 1, np.uint64)
        for k in range(WINDOW):
            h = h * mult + w[k : len(w) - WINDOW + 1 + k]
        doc = np.repeat(np.arange(texts_n), np.diff(first))
        whole = np.flatnonzero(doc[: len(h)] == doc[WINDOW - 1 :])
        order = whole[np.lexsort((h[whole], doc[whole]))]
        same = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        begin = np.sort(order[twice])
        np.add.at(repeat, begin, 1)
        np.add.at(repeat, begin + WINDOW, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(repeat)[:-1] > 0)])
    out["n_repeat_words"] = covered[first[1:]] - covered[first[:-1]]
    return out


def slot_ratios(docs: DataFrame, trusted: DataFrame) -> np.ndarray:
    """log(p_target / p_raw) of every slot. trusted(doc_id): ids of trusted documents."""
    kind = "slot int, raw long, target long"
    schema = arrow_schema(kind, docs.sparkSession)
    marked = small_join(docs.select("doc_id", "text"), trusted.select("doc_id").where("doc_id is not null").distinct().withColumn("trusted", F.lit(True)), ["doc_id"], "left", 16)

    def count(batches):
        raw, target = np.zeros(1 << HASH_BITS, np.int64), np.zeros(1 << HASH_BITS, np.int64)
        for batch in batches:
            mark = np.asarray(batch.column(1).is_valid())
            for i, j, data, offsets in chunks(texts(batch.column(0))):
                g, first = slots(data, offsets)
                raw += np.bincount(g, minlength=1 << HASH_BITS)
                target += np.bincount(g[np.repeat(mark[i:j], np.diff(first))], minlength=1 << HASH_BITS)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(target[at])], schema=schema)

    found = marked.select("text", "trusted").mapInArrow(tidy(count), kind).groupBy("slot").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.full(1 << HASH_BITS, SMOOTHING), np.full(1 << HASH_BITS, SMOOTHING)
    for r in found:
        raw[r["slot"]] += r["raw"]
        target[r["slot"]] += r["target"]
    if target.sum() <= SMOOTHING * (1 << HASH_BITS):
        return np.zeros(1 << HASH_BITS)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


RULED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, llr double, kept boolean"


def apply_rules(docs: DataFrame, ratios: np.ndarray, keep_from: float = KEEP_FROM) -> DataFrame:
    schema = arrow_schema(RULED, docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(ratios)

    def judge(batches):
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            for i, j, data, offsets in chunks(texts(batch.column(1))):
                c = base_counts(data, offsets)
                g, first = slots(data, offsets)
                total = np.concatenate([[0.0], np.cumsum(sent.value[g])])
                llr = (total[first[1:]] - total[first[:-1]]) / np.maximum(np.diff(first), 1)
                failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > REPEAT_PERCENT * c["n_words"])
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), *(pa.array(c[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), pa.array(failed), pa.array(llr), pa.array(~failed & (np.round(llr, 9) >= keep_from))], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(tidy(judge), RULED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    trusted = read(spark, sf_dir, "labels").where("quality = 1")
    return apply_rules(docs, slot_ratios(docs, trusted))
