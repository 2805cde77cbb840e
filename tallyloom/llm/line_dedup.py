"""Line dedup: sharded cuckoo filters over exact reference counts, reversible by insertions and deletions of documents.

A line's key is the line stripped of white space at both ends with A-Z lower-cased; it is stored as a 128-bit digest. The
reference-count table holds, exactly, the number of documents of every key. Keys counted in at least ``min_docs`` documents
are *common*; each shard's cuckoo filter holds their fingerprints. Documents are cleaned by probing the filters while their
text streams by, without shuffling any text. A key that the filters hit by chance is found beforehand, by probing the
filters with the rest of the exact table, and travels along as an exception: the filters plus exceptions are exact.
Only RESIDENT_KEYS keys' filters, the most frequent ones, go to all tasks. Where there are more common keys, the other
filters stay in their shards, each built from its part of the exact table, and the keys of the remaining lines go to them.

Defined cases: a null or empty text is one empty line; empty keys are never counted or dropped; each row is one document,
also where rows repeat a doc_id; an empty table gives an empty result; extra columns pass through ``drop_lines`` untouched
(its results take other names if asked to, and replace columns of the same name), and through ``stage`` in any case.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, blob, BROADCAST_BYTES, bucket_count, by_bucket, groups, materialize, mix, numbered, read, scatter, sha256, small_join, SPACES, texts, tidy, unused

MIN_DOCS = 10
MIN_CHARS = 1
#: Shards of a kept index, keys (or lines that ask for keys) of a shard otherwise, and filter keys sent to all tasks (10 bytes each at most).
SHARDS, SHARD_KEYS, RESIDENT_KEYS = 64, 1 << 17, BROADCAST_BYTES // 10
SLOTS = 4
COUNTS = "k1 long, k2 long, docs long"


class CuckooFilter:
    """Buckets of SLOTS 32-bit fingerprints; supports insertion, deletion and bulk lookup. Capacity doubles when full."""

    def __init__(self, expected: int):
        self.n = 1 << max(4, int(np.ceil(np.log2(max(1, expected) / (SLOTS * 0.8)))))
        self.table = np.zeros((self.n, SLOTS), np.uint32)
        self.kicks = 500

    @staticmethod
    def fingerprint(k2: np.ndarray) -> np.ndarray:
        f = (mix(k2.view(np.uint64)) >> np.uint64(32)).astype(np.uint32)
        f[f == 0] = 1
        return f

    def places(self, k1: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a = mix(k1.view(np.uint64)) & np.uint64(self.n - 1)
        return a, a ^ (mix(f.astype(np.uint64)) & np.uint64(self.n - 1))

    def insert(self, k1: np.ndarray, k2: np.ndarray) -> bool:
        """False if a key found no place; the caller then builds a larger filter from the exact table."""
        f = self.fingerprint(k2)
        a, b = self.places(k1, f)
        rng = np.random.default_rng(7)
        for x, i, j in zip(f.tolist(), a.tolist(), b.tolist(), strict=True):
            for p in (i, j):
                free = np.flatnonzero(self.table[p] == 0)
                if len(free):
                    self.table[p, free[0]] = x
                    break
            else:
                p = j
                for _ in range(self.kicks):
                    s = int(rng.integers(SLOTS))
                    x, self.table[p, s] = int(self.table[p, s]), x
                    p ^= int(mix(np.array([x], np.uint64))[0]) & (self.n - 1)
                    free = np.flatnonzero(self.table[p] == 0)
                    if len(free):
                        self.table[p, free[0]] = x
                        break
                else:
                    return False
        return True

    def delete(self, k1: np.ndarray, k2: np.ndarray) -> None:
        """Delete keys that were inserted before."""
        f = self.fingerprint(k2)
        for x, i, j in zip(f.tolist(), *(p.tolist() for p in self.places(k1, f)), strict=True):
            for p in (i, j):
                at = np.flatnonzero(self.table[p] == x)
                if len(at):
                    self.table[p, at[0]] = 0
                    break

    def contains(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        f = self.fingerprint(k2)
        a, b = self.places(k1, f)
        return (self.table[a.astype(np.int64)] == f[:, None]).any(1) | (self.table[b.astype(np.int64)] == f[:, None]).any(1)

    @classmethod
    def build(cls, k1: np.ndarray, k2: np.ndarray) -> CuckooFilter:
        size = max(1, len(k1))
        while not (f := cls(size)).insert(k1, k2):
            size *= 2
        return f

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        f = cls(1)
        f.table = np.frombuffer(data, np.uint32).reshape(-1, SLOTS).copy()
        f.n = len(f.table)
        return f


def shard_of(k1: np.ndarray, shards: int) -> np.ndarray:
    return (k1.view(np.uint64) >> np.uint64(3)) % np.uint64(shards)


class Screen:
    """The shards' filters with the keys that they hit by chance."""

    def __init__(self, filters: dict[int, bytes], exceptions: list[tuple[int, int]], shards: int):
        self.filters, self.shards = filters, shards
        self.exceptions = np.array(sorted(exceptions), np.int64).reshape(-1, 2)
        self.ready: dict[int, CuckooFilter] = {}

    def hits(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        out, shard = np.zeros(len(k1), bool), shard_of(k1, self.shards)
        for s in np.unique(shard):
            if int(s) in self.filters:
                f = self.ready.setdefault(int(s), CuckooFilter.load(self.filters[int(s)])) if int(s) not in self.ready else self.ready[int(s)]
                at = np.flatnonzero(shard == s)
                out[at] = f.contains(k1[at], k2[at])
        return out

    def common(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        out = self.hits(k1, k2)
        if len(self.exceptions):
            bad = set(map(tuple, self.exceptions.tolist()))
            for i in np.flatnonzero(out & np.isin(k1, self.exceptions[:, 0])):
                out[i] = (int(k1[i]), int(k2[i])) not in bad
        return out


def line_keys(text: pa.Array, min_chars: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lines, first line of each text, index of each line's distinct key, k1, k2 of the distinct keys); index -1: no key."""
    split = pc.split_pattern(text, "\n")
    first = np.asarray(split.offsets).astype(np.int64)
    lines = split.flatten()
    first = first - first[0]
    keys = pc.ascii_lower(pc.ascii_trim(lines, characters=SPACES)).dictionary_encode()
    distinct = keys.dictionary
    ids = np.asarray(keys.indices).astype(np.int64)
    counted = np.asarray(pc.greater_equal(pc.utf8_length(distinct), min_chars)).astype(bool)
    digest = b"".join(hashlib.blake2b(x.as_buffer(), digest_size=16).digest() for x in distinct)
    k = np.frombuffer(digest, np.int64).reshape(-1, 2)
    ids[~counted[ids]] = -1
    return lines, first, ids, np.ascontiguousarray(k[:, 0]), np.ascontiguousarray(k[:, 1])


def _pieces(text: pa.Array, size: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes of text, to bound the memory of a batch of long texts."""
    length = np.asarray(pc.binary_length(text)).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(length)])
    i = 0
    while i < len(text):
        j = max(i + 1, int(np.searchsorted(total, total[i] + size, "right")) - 1)
        yield i, j
        i = j


def line_counts(docs: DataFrame, text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """Exact reference counts (k1, k2, docs) of all keys; counts are combined before and at the shuffle."""
    schema = arrow_schema(COUNTS, docs.sparkSession)

    def count(batches):
        for batch in batches:
            column = texts(batch.column(0))
            for i, j in _pieces(column):
                _, first, ids, k1, k2 = line_keys(column.slice(i, j - i), min_chars)
                doc = np.repeat(np.arange(j - i), np.diff(first))
                seen = np.unique(doc[ids >= 0] * (len(k1) + 1) + ids[ids >= 0])
                n = np.bincount(seen % (len(k1) + 1), minlength=len(k1))
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(k1[at]), pa.array(k2[at]), pa.array(n[at].astype(np.int64))], schema=schema)

    return docs.select(text).mapInArrow(tidy(count), COUNTS).groupBy("k1", "k2").agg(F.sum("docs").alias("docs"))


def build_filters(counts: DataFrame, min_docs: int = MIN_DOCS, shards: int = SHARDS) -> DataFrame:
    """(shard, filter) with a cuckoo filter of the common keys of each shard."""

    def build(key, pdf):
        import pandas as pd

        k1, k2 = pdf["k1"].to_numpy(np.int64).copy(), pdf["k2"].to_numpy(np.int64).copy()
        return pd.DataFrame({"shard": [int(key[0])], "filter": [CuckooFilter.build(k1, k2).table.tobytes()]})

    shard = F.pmod(F.shiftrightunsigned("k1", 3), F.lit(shards))
    return counts.where(F.col("docs") >= min_docs).withColumn("shard", shard).groupBy("shard").applyInPandas(build, "shard long, filter binary")


def _chance_hits(counts: DataFrame, screen, least: int) -> DataFrame:
    """Keys of the exact table that are in fewer than ``least`` documents, yet hit by the filters."""

    def probe(batches):
        for batch in batches:
            k1, k2 = (np.asarray(batch.column(i)).copy() for i in (0, 1))
            yield batch.filter(pa.array(screen.value.hits(k1, k2)))

    return counts.where(F.col("docs") < least).mapInArrow(tidy(probe), COUNTS)


def _clean(docs: DataFrame, text: str, min_chars: int, decide, extra: str, results: tuple[str, str]) -> DataFrame:
    """Drop lines by ``decide(batch rows, ids, k1, k2, rows of lines)``; all columns of docs but ``extra`` pass through, then the results."""
    keep = [f for f in docs.schema.fields if f.name not in (*results, extra)]
    docs = docs.select(*(f.name for f in docs.schema.fields if f.name not in results))
    out = T.StructType([*keep, *(T.StructField(n, T.LongType()) for n in results)])
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(out)

    def run(batches):
        for batch in batches:
            whole = texts(batch.column(batch.schema.get_field_index(text)))
            for i, j in _pieces(whole):
                part = batch.slice(i, j - i)
                lines, first, ids, k1, k2 = line_keys(whole.slice(i, j - i), min_chars)
                line_doc = np.repeat(np.arange(j - i), np.diff(first))
                drop = decide(part, ids, k1, k2, line_doc)
                n = np.diff(first)
                kept = lines.filter(pa.array(~drop))
                n_drop = np.bincount(line_doc[drop], minlength=j - i)
                at = np.concatenate([[0], np.cumsum(n - n_drop)]).astype(np.int32)
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(at), kept), "\n")
                columns = []
                for f in schema:
                    if f.name == text:
                        # texts that lose nothing stay as they are, nulls included
                        columns.append(pc.if_else(pa.array(n_drop > 0), joined, part.column(part.schema.get_field_index(text)).cast(pa.string())))
                    elif f.name == results[0]:
                        columns.append(pa.array(n.astype(np.int64)))
                    elif f.name == results[1]:
                        columns.append(pa.array(n_drop.astype(np.int64)))
                    else:
                        columns.append(part.column(part.schema.get_field_index(f.name)).cast(f.type))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.mapInArrow(tidy(run), out)


def _resident_from(counts: DataFrame, min_docs: int, resident_keys: int) -> int:
    """The least number of documents from which on keys' filters are sent to all tasks: ``min_docs``, or the power of two that leaves no more than ``resident_keys``."""
    power = F.floor(F.log2("docs")).cast("int")
    sizes = sorted(((r["p"], r["n"]) for r in counts.where(F.col("docs") >= min_docs).groupBy(power.alias("p")).agg(F.count("*").alias("n")).collect()), reverse=True)
    left = resident_keys
    for p, n in sizes:
        if n > left:
            return max(min_docs, 2 << p)
        left -= n
    return min_docs


def drop_lines(docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, shards: int | None = None, resident_keys: int = RESIDENT_KEYS, counts: DataFrame | None = None, results: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """docs with the lines of common keys dropped from ``text``, plus the results (lines before, and dropped).

    counts: a kept reference-count table (LineIndex); by default it is made from docs. Filters of the most frequent common
    keys, ``resident_keys`` of them at most, are sent to all tasks. If there are more common keys, the other filters stay
    with their shards, and the keys of the lines that the first ones do not drop go there.
    """
    counts = materialize(line_counts(docs, text, min_chars), "line-counts") if counts is None else counts
    least = _resident_from(counts, min_docs, resident_keys)
    resident = counts.where(F.col("docs") >= least)
    shards = shards or max(1, -(-resident.count() // SHARD_KEYS))
    content = {r["shard"]: bytes(r["filter"]) for r in build_filters(resident, least, shards).collect()}
    sc = docs.sparkSession.sparkContext
    screen = sc.broadcast(Screen(content, [], shards))
    # Fingerprints of 32 bits: one key in 5 * 10 ** 8 that is not resident is among these, 16 bytes each.
    chance = _chance_hits(counts, screen, least).select("k1", "k2").collect() if content else []
    exact = sc.broadcast(Screen(content, [(r["k1"], r["k2"]) for r in chance], shards)) if chance else screen

    def common(ids, k1, k2):
        return (ids >= 0) & np.append(exact.value.common(k1, k2), False)[ids]

    if least == min_docs:
        return _clean(docs, text, min_chars, lambda part, ids, k1, k2, doc: common(ids, k1, k2), "", results)
    row, extra = unused("row", docs.columns), unused("drops", docs.columns)
    keyed = numbered(docs, row)
    hits = materialize(_routed_hits(keyed.select(F.col(row).alias("row"), F.col(text).alias("text")), counts.where(F.col("docs") < least), min_docs, min_chars, exact), "line-hits")
    found = hits.groupBy("row").agg(F.collect_list(F.struct("k1", "k2")).alias(extra)).withColumnRenamed("row", row)
    marked = small_join(keyed, found, [row], "left", 48, hits.count())

    def decide(part, ids, k1, k2, line_doc):
        out = common(ids, k1, k2)
        drops = [{(x["k1"], x["k2"]) for x in d} if d else None for d in part.column(part.schema.get_field_index(extra)).to_pylist()]
        at = np.flatnonzero(np.array([d is not None for d in drops])[line_doc] & (ids >= 0) & ~out) if len(line_doc) else []
        for i in at:
            out[i] = (int(k1[ids[i]]), int(k2[ids[i]])) in drops[line_doc[i]]
        return out

    return _clean(marked.drop(row), text, min_chars, decide, extra, results)


ROUTED = "bucket int, row binary, k1 binary, k2 binary, docs binary"


def _routed_hits(docs: DataFrame, counts: DataFrame, min_docs: int, min_chars: int, resident) -> DataFrame:
    """(row, k1, k2) of lines of docs(row, text) with common keys of counts: each shard builds its filter where its lines come.

    counts has no key of more documents than a share of all that ``resident`` leaves, so no shard is hot.
    """
    spark = docs.sparkSession
    kind = "row long, k1 long, k2 long"
    schema, found = arrow_schema(ROUTED, spark), arrow_schema(kind, spark)
    total = counts.agg(F.sum("docs")).first()[0] or 0
    shards = bucket_count(total, SHARD_KEYS)

    def blobs(columns):
        names = ("row", "k1", "k2", "docs")
        parts = [(b, dict(zip(columns, x, strict=True))) for b, x in scatter(columns["k1"].view(np.uint64), list(columns.values()), shards)]
        return pa.RecordBatch.from_arrays([pa.array([b for b, _ in parts], pa.int32()), *(pa.array([x.get(n) for _, x in parts], pa.binary()) for n in names)], schema=schema)

    def table(batches):
        for batch in batches:
            k1, k2, n = (np.asarray(batch.column(i)) for i in range(3))
            yield blobs({"k1": k1, "k2": k2, "docs": n})

    def lines(batches):
        for batch in batches:
            rows, column = np.asarray(batch.column(0).cast(pa.int64())), texts(batch.column(1))
            for i, j in _pieces(column):
                _, first, ids, k1, k2 = line_keys(column.slice(i, j - i), min_chars)
                if not len(k1):
                    continue
                rest = np.append(~resident.value.common(k1, k2), False)
                doc = np.repeat(rows[i:j], np.diff(first))
                wanted = rest[ids]
                seen = np.unique(np.stack([doc[wanted], ids[wanted]], 1), axis=0)
                if len(seen):
                    yield blobs({"k1": k1[seen[:, 1]], "k2": k2[seen[:, 1]], "row": seen[:, 0].copy()})

    def probe(batches):
        for _, held in groups(batches):
            known = held.filter(pc.is_valid(held.column("docs")))
            asked = held.filter(pc.is_valid(held.column("row")))
            k1, k2, n = (blob(known, c, np.int64) for c in ("k1", "k2", "docs"))
            often = n >= min_docs
            if not often.any() or not asked.num_rows:
                continue
            screen = Screen({0: CuckooFilter.build(k1[often], k2[often]).table.tobytes()}, [], 1)
            chance = screen.hits(k1[~often], k2[~often])
            screen = Screen(screen.filters, list(zip(k1[~often][chance].tolist(), k2[~often][chance].tolist(), strict=True)), 1)
            rows, k1, k2 = (blob(asked, c, np.int64) for c in ("row", "k1", "k2"))
            hit = screen.common(k1, k2)
            yield pa.RecordBatch.from_arrays([pa.array(x[hit]) for x in (rows, k1, k2)], schema=found)

    both = counts.select("k1", "k2", "docs").mapInArrow(tidy(table), ROUTED).unionByName(docs.select("row", "text").mapInArrow(tidy(lines), ROUTED))
    return by_bucket(both, shards).mapInArrow(tidy(probe), kind)


class LineIndex:
    """A kept reference-count table: documents can be inserted and deleted, and the table after both is as if never inserted."""

    def __init__(self, counts: DataFrame):
        self.counts = counts

    @classmethod
    def of(cls, docs: DataFrame, text: str = "text", min_chars: int = MIN_CHARS) -> LineIndex:
        return cls(materialize(line_counts(docs, text, min_chars), "line-index"))

    def _changed(self, docs: DataFrame, sign: int, text: str, min_chars: int) -> LineIndex:
        delta = line_counts(docs, text, min_chars).withColumn("docs", F.col("docs") * sign)
        merged = self.counts.unionByName(delta).groupBy("k1", "k2").agg(F.sum("docs").alias("docs")).where("docs > 0")
        return LineIndex(materialize(merged, "line-index"))

    def insert(self, docs: DataFrame, text: str = "text", min_chars: int = MIN_CHARS) -> LineIndex:
        return self._changed(docs, 1, text, min_chars)

    def delete(self, docs: DataFrame, text: str = "text", min_chars: int = MIN_CHARS) -> LineIndex:
        return self._changed(docs, -1, text, min_chars)

    def update_filters(self, filters: dict[int, bytes], older: LineIndex, min_docs: int = MIN_DOCS, shards: int = SHARDS) -> DataFrame:
        """(shard, filter) after moving only the keys whose being common changed between ``older`` and this index."""
        old = older.counts.select("k1", "k2", F.col("docs").alias("was"))
        moved = self.counts.join(old, ["k1", "k2"], "full").fillna(0, ["docs", "was"]).where((F.col("docs") >= min_docs) != (F.col("was") >= min_docs))
        sent = self.counts.sparkSession.sparkContext.broadcast(filters)

        def change(key, pdf):
            import pandas as pd

            f = CuckooFilter.load(sent.value[int(key[0])]) if int(key[0]) in sent.value else CuckooFilter(len(pdf))
            gone, new = pdf[pdf["docs"] < min_docs], pdf[pdf["docs"] >= min_docs]
            f.delete(gone["k1"].to_numpy(np.int64).copy(), gone["k2"].to_numpy(np.int64).copy())
            full = not f.insert(new["k1"].to_numpy(np.int64).copy(), new["k2"].to_numpy(np.int64).copy())
            return pd.DataFrame({"shard": [int(key[0])], "filter": [None if full else f.table.tobytes()]})  # null: rebuild the shard

        shard = F.pmod(F.shiftrightunsigned("k1", 3), F.lit(shards))
        return moved.withColumn("shard", shard).groupBy("shard").applyInPandas(change, "shard long, filter binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = "doc_id long, n_lines long, n_dropped long, kept_sha256 string"
    schema = arrow_schema(out, spark)
    cleaned = drop_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))

    def digest(batches):
        for batch in batches:
            b = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            hashes = [sha256(x.as_buffer()) if x.is_valid else sha256(b"") for x in b["text"]]
            yield pa.RecordBatch.from_arrays([b["doc_id"].cast(pa.int64()), b["n_lines"], b["n_dropped"], pa.array(hashes, pa.string())], schema=schema)

    return cleaned.mapInArrow(tidy(digest), out)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with common lines dropped, in their own columns; n_chars follows the text."""
    names = (unused("n_lines", docs.columns), unused("n_dropped", docs.columns))
    out = drop_lines(docs, results=names).select(*docs.columns)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast("long"))) if "n_chars" in docs.columns else out


CLEAN_SQL = r"""
line_rows AS (SELECT row_no, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT row_no, unnest(string_split(COALESCE(text, ''), chr(10))) AS line, generate_subscripts(string_split(COALESCE(text, ''), chr(10)), 1) AS pos FROM numbered)),
common AS (SELECT key FROM line_rows WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT row_no) >= 10),
cleaned AS (SELECT row_no, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE c.key IS NOT NULL)::BIGINT AS n_dropped,
  COALESCE(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '') AS kept
  FROM line_rows l LEFT JOIN common c ON l.key = c.key GROUP BY row_no)"""

ORACLE_SQL = "WITH numbered AS (SELECT *, row_number() OVER () AS row_no FROM documents)," + CLEAN_SQL + """
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM cleaned JOIN numbered USING (row_no)"""
