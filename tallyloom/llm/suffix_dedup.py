"""Removal of repeated 100-byte strings by prefix-free parsing.

Texts are parsed at rolling-hash triggers: a place is a trigger if the hash of its K bytes is the least (leftmost of equals)
among those of some window of LENGTH - K + 1 places. So each 100-byte string holds the trigger that it names itself, wherever
it occurs, and the runs of strings that name one trigger are the phrases of the parse. A string is a suffix of its phrase's
context (all bytes of the phrase's strings), cut at the depth of 100 bytes that is asked for. Corpus order is (doc_id, row,
start). The two suffix orders of a prefix-free parse are made in parts that are dealt out by trigger:

1. Parse. The phrases of a part are sorted by (trigger, context, corpus order): the suffix order of the parse at that depth,
   where phrases go by fingerprints, as usual. All but the first phrase of equal ones repeat it as a whole.
2. Dictionary. Only where one trigger stands in different contexts may single strings still be equal. The bytes of those
   contexts, each once in the corpus, meet in their trigger's part; a suffix array of them by prefix doubling (8, 16, 32, 64,
   100 bytes) puts strings with a common prefix of 100 bytes side by side, and with the first places from the parse, corpus
   order tells which of them stays. Equality of strings is by their bytes here.

Fingerprints: phrases with the same trigger (64 bits) are equal if their contexts' 64 bits are; m unlike contexts of one
trigger give m * m / 2 ** 65 false pairs on average, if hashes act as random. Texts made to collide are not guarded against.
Repeats are never missed. A task combines its own rows first, so a group of copies sends one phrase a task. A trigger with
MANY contexts in one task, or HOT in all, is dealt by single strings instead (128-bit fingerprints), as its contexts would
fill one part; so no trigger, string or group of copies fills a task.

Defined cases: null texts are empty; texts under LENGTH bytes lose nothing; matches never cross documents; every row is a
document of its own: of rows that repeat a doc_id, the order of their row keys (``numbered``) decides which is earlier; rows
without a doc_id come last, in the order of their row keys; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, blob, BROADCAST_BYTES, bucket_count, by_bucket, chunks, groups, _INVERSE, materialize, mix, numbered, plan_bytes, powers, raw_bytes, read, rolling, scatter, span_hash, texts, tidy

LENGTH, K = 100, 32
BUCKET_BYTES = 4 << 20
#: Phrases or strings that a task gathers before it combines them (more with many buckets, so that blobs hold some rows each).
FLUSH, A_BLOB = 500_000, 4
#: Contexts of one trigger, in a task and in all, that have it dealt by single strings.
MANY, HOT = 256, 4096
#: Bytes of contexts that one suffix array is made of; a trigger's contexts stay together.
ARRAY_BYTES = 4 << 20
#: A longer text is parsed in slices that overlap by LENGTH - 1 bytes; places take 24 bits beside 40 bits of hash.
SLICE = 1 << 24
LAST = (1 << 63) - 1
PHRASES = "bucket int, kind int, trigger binary, context binary, doc binary, row binary, lo binary, hi binary"
SPANS = "doc long, row long, removed binary, asked binary"
#: Kinds of blobs: phrases of a part; starts that go; starts to look at by their contexts' bytes, and string by string.
PHRASE, GONE, ASKED, SINGLY = 0, 1, 2, 3


def _grams(prefix: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Hashes of the K bytes from each place on."""
    return mix((prefix[place + K] - prefix[place]) * powers(len(prefix), _INVERSE)[place] + np.uint64(K))


def triggers(content: np.ndarray, first: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Trigger hash of each phrase, of whose context ``content`` has the bytes from ``first`` on and which has that many starts."""
    entry, place = _within(first + starts - 1, LENGTH - K + 2 - starts)  # all places within each of its strings
    gram, low = _grams(rolling(content), place), np.uint64(SLICE - 1)
    head = np.flatnonzero(_runs(entry))
    best = np.minimum.reduceat((gram & ~low) | (place - first[entry]).astype(np.uint64), head) if len(head) else gram
    return gram[head + (best & low).astype(np.int64) - (starts - 1)]


def phrases(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(trigger hash, context hash, text index, first and last start) of the phrases of a run of texts; starts in the run."""
    n = len(data)
    if n < LENGTH:
        return (np.zeros(0, np.uint64), np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    prefix = rolling(data)
    m, width = n - K + 1, LENGTH - K + 1
    gram = _grams(prefix, np.arange(m))
    ends = np.repeat(offsets[1:], np.diff(offsets))
    place = np.arange(m)
    low = np.uint64(SLICE - 1)
    key = (gram & ~low) | place.astype(np.uint64)
    key[place + K > ends[:m]] = np.uint64(2**64 - 1)
    least, span = key, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    count = m - width + 1
    least = np.minimum(least[:count], least[width - span : width - span + count])
    starts = np.flatnonzero(place[:count] + LENGTH <= ends[:count])
    if not len(starts):
        return (np.zeros(0, np.uint64), np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    at = (least[starts] & low).astype(np.int64)
    cut = np.flatnonzero(np.diff(at, prepend=-1))
    lo, hi = starts[cut], starts[np.append(cut[1:], len(at)) - 1]
    return gram[at[cut]], span_hash(prefix, lo, hi + LENGTH), np.searchsorted(offsets, lo, "right") - 1, lo, hi


def _parsed(column: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
    """phrases() of a column: (trigger, context, row, first start, last start), starts within the text."""
    for i, j, data, offsets in chunks(column):
        step = SLICE - LENGTH + 1
        for s in range(0, max(1, len(data)), step) if j == i + 1 and len(data) > SLICE else (0,):
            part = data[s : s + SLICE] if len(data) > SLICE else data
            t, c, row, lo, hi = phrases(part, np.array([0, len(part)]) if len(data) > SLICE else offsets)
            base = -s if len(data) > SLICE else offsets[row]
            yield t, c, row + i, lo - base, hi - base


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Whether each row differs from the one before in any key."""
    fresh = np.ones(len(keys[0]), bool)
    fresh[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys]) if len(keys[0]) else False
    return fresh


def _sizes(heads: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(heads, n))


def _by_doc(kind: int, doc: np.ndarray, row: np.ndarray, lo: np.ndarray, hi: np.ndarray, buckets: int) -> Iterator[dict]:
    """Blobs of starts lo to hi, by bucket of documents."""
    for b, (d, r, x, y) in scatter(mix(doc.view(np.uint64) + mix(row.view(np.uint64))), [doc, row, lo.astype(np.int32), (hi - lo).astype(np.int32)], buckets):
        yield {"bucket": b, "kind": kind, "doc": d, "row": r, "lo": x, "hi": y}


def _emit(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _passing(batches: Iterator[pa.RecordBatch], kinds: tuple[int, ...]) -> Iterator[tuple[pa.Table | None, list[pa.RecordBatch]]]:
    """(blobs of one bucket, of the kinds to be worked on; what passes through untouched)."""
    through: list[pa.RecordBatch] = []

    def parts():
        for batch in batches:
            mine = pc.is_in(batch.column(1), pa.array(kinds, pa.int32()))
            if (rest := batch.filter(pc.invert(mine))).num_rows:
                through.append(rest)
            yield batch.filter(mine)

    for _, table in groups(parts()):
        yield table, through[:]
        through.clear()
    yield None, through


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(batch.column(0).cast(pa.int64())), np.asarray(batch.column(1).cast(pa.int64()))


def _first_contexts(docs: DataFrame, buckets: int) -> DataFrame:
    """Step 1: blobs of starts that go, and of starts to look at, by bucket of documents."""
    schema = arrow_schema(PHRASES, docs.sparkSession)
    flush = max(FLUSH, A_BLOB * buckets)

    def combine(t, c, doc, row, lo, hi):
        order = np.lexsort((lo, row, doc, c, t))
        t, c, doc, row, lo, hi = (x[order] for x in (t, c, doc, row, lo, hi))
        late = ~_runs(t, c)
        out = list(_by_doc(GONE, doc[late], row[late], lo[late], hi[late], buckets)) if late.any() else []
        t, c, doc, row, lo, hi = (x[~late] for x in (t, c, doc, row, lo, hi))
        head = np.flatnonzero(_runs(t))
        size = _sizes(head, len(t))
        many = np.repeat(size >= MANY, size)
        if many.any():
            out += _by_doc(SINGLY, doc[many], row[many], lo[many], hi[many], buckets)
        witness = t[head[size >= MANY]]  # stands for many contexts, with no place of its own
        none = np.full(len(witness), -1)
        columns = [np.append(t[~many], witness), np.append(c[~many], ~witness), np.append(doc[~many], none), np.append(row[~many], none), np.append(lo[~many], none).astype(np.int32), np.append(hi[~many] - lo[~many], none + 1).astype(np.uint8)]
        out += [{"bucket": b, "kind": PHRASE, **dict(zip(("trigger", "context", "doc", "row", "lo", "hi"), parts, strict=True))} for b, parts in scatter(columns[0], columns, buckets)]
        return _emit(out, schema)

    def parse(batches):
        held, size = [], 0
        for batch in batches:
            ids, rows = _ids(batch)
            for t, c, at, lo, hi in _parsed(texts(batch.column(2))):
                held.append((t, c, ids[at], rows[at], lo, hi))
                size += len(t)
                if size >= flush:
                    yield combine(*map(np.concatenate, zip(*held, strict=True)))
                    held, size = [], 0
        if size:
            yield combine(*map(np.concatenate, zip(*held, strict=True)))

    def match(batches):
        for table, through in _passing(batches, (PHRASE,)):
            yield from through
            if table is None:
                continue
            t, c, doc, row = blob(table, "trigger", np.uint64), blob(table, "context", np.uint64), blob(table, "doc", np.int64), blob(table, "row", np.int64)
            lo = blob(table, "lo", np.int32).astype(np.int64)
            hi = lo + blob(table, "hi", np.uint8)
            order = np.lexsort((lo, row, doc, c, t))
            t, c, doc, row, lo, hi = (x[order] for x in (t, c, doc, row, lo, hi))
            real, fresh = lo >= 0, _runs(t, c)
            late = ~fresh & real
            head = np.flatnonzero(_runs(t))
            size = _sizes(head, len(t))
            kinds = np.add.reduceat((fresh & real).astype(np.int64), head) if len(head) else head
            seen = np.add.reduceat((~real).astype(np.int64), head) if len(head) else head
            ask = np.repeat((kinds > 1) | (seen > 0), size) & real & ~late
            hot = np.repeat((kinds >= HOT) | (seen > 0), size)
            out = list(_by_doc(GONE, doc[late], row[late], lo[late], hi[late], buckets))
            for kind, which in ((ASKED, ask & ~hot), (SINGLY, ask & hot)):
                out += _by_doc(kind, doc[which], row[which], lo[which], hi[which], buckets)
            yield _emit(out, schema)

    return by_bucket(docs.mapInArrow(tidy(parse), PHRASES), buckets).mapInArrow(tidy(match), PHRASES)


def _merged(lo: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of the byte ranges [lo, end), sorted by lo, as maximal runs."""
    top = np.maximum.accumulate(end)
    cut = np.flatnonzero(np.append(True, lo[1:] > top[:-1]))
    return lo[cut], top[np.append(cut[1:], len(lo)) - 1]


def _pack(lo: np.ndarray, more: np.ndarray, kind: np.ndarray) -> bytes:
    """Phrases of a document in five bytes each: first start, and number of further ones (68 at most) with the kind."""
    return lo.astype(np.int32).tobytes() + (more * 2 + (kind == SINGLY)).astype(np.uint8).tobytes()


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, number of starts, kind) of phrases."""
    n = len(data) // 5
    last = np.frombuffer(data, np.uint8)[4 * n :].astype(np.int64)
    return np.frombuffer(data, np.int32, n).astype(np.int64), last // 2 + 1, np.where(last % 2, SINGLY, ASKED)


def _spans(blobs: DataFrame, buckets: int) -> DataFrame:
    """One row a document: byte ranges that go, and phrases that are to be looked at (``_pack``)."""
    schema = arrow_schema(SPANS, blobs.sparkSession)

    def gather(batches):
        for _, table in groups(batches):
            ready: dict[tuple[int, int], list] = {}
            for gone in (True, False):
                part = table.filter(pc.equal(table.column("kind"), GONE) if gone else pc.greater(table.column("kind"), GONE))
                if not part.num_rows:
                    continue
                doc, row = (blob(part, n, np.int64) for n in ("doc", "row"))
                lo, more = (blob(part, n, np.int32).astype(np.int64) for n in ("lo", "hi"))
                kind = np.repeat(np.asarray(part.column("kind")).astype(np.int64), [len(x) // 8 for x in part.column("doc").to_pylist()])
                order = np.lexsort((lo, row, doc))
                doc, row, lo, more, kind = (x[order] for x in (doc, row, lo, more, kind))
                cuts = np.flatnonzero(_runs(doc, row))
                for a, b in zip(cuts, np.append(cuts[1:], len(doc)), strict=True):
                    found = np.stack(_merged(lo[a:b], lo[a:b] + more[a:b] + LENGTH), 1).tobytes() if gone else _pack(lo[a:b], more[a:b], kind[a:b])
                    ready.setdefault((int(doc[a]), int(row[a])), [None, None])[not gone] = found
            keys = list(ready)
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in keys], pa.int64()), pa.array([r for _, r in keys], pa.int64()), pa.array([r for r, _ in ready.values()], pa.binary()), pa.array([a for _, a in ready.values()], pa.binary())], schema=schema)

    return by_bucket(blobs.select("bucket", "kind", "doc", "row", "lo", "hi"), buckets).mapInArrow(tidy(gather), SPANS)


def _rank(key: np.ndarray) -> np.ndarray:
    """Dense ranks of 64-bit keys."""
    order = np.argsort(key)
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(_runs(key[order])) - 1
    return out.view(np.uint64)


def suffix_order(text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, head): starts in the order of their suffixes cut at LENGTH bytes, and whether each has less than that in common with the one before.

    Prefix doubling: ranks of 8, 16, 32 and 64 bytes at all places, then of LENGTH bytes at the starts.
    """
    padded = np.concatenate([text, np.zeros(LENGTH, np.uint8)])
    n, rank = len(text), np.zeros(len(text), np.uint64)
    for k in range(8):
        rank = (rank << np.uint64(8)) | padded[k : n + k].astype(np.uint64)
    depth = 8
    while depth * 2 <= LENGTH:
        rank = _rank(rank) + np.uint64(1)
        rank = (rank << np.uint64(32)) | np.append(rank[depth:], np.zeros(depth, np.uint64))[:n]
        depth *= 2
    rank = _rank(rank)
    key = (rank[starts] << np.uint64(32)) | rank[starts + LENGTH - depth]
    order = np.argsort(key, kind="stable")
    return order, _runs(key[order])


def _late_strings(head: np.ndarray, order: np.ndarray, doc: np.ndarray, row: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Indices of strings that equal one which is earlier in corpus order; doc, row and lo of each string, not in ``order``."""
    group = np.cumsum(head) - 1
    shared = np.bincount(group)[group] > 1
    order, group = order[shared], group[shared]
    again = np.lexsort((lo[order], row[order], doc[order], group))
    return order[again[~_runs(group[again])]]


def _as_runs(entry: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, first start, last start) of maximal runs of starts, within their entries."""
    order = np.lexsort((start, entry))
    entry, start = entry[order], start[order]
    cut = np.ones(len(entry), bool)
    cut[1:] = (entry[1:] != entry[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(cut)
    return entry[at], start[at], start[np.append(at[1:], len(start)) - 1] if len(at) else start


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


def _within(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) for all numbers from each row's first, as many as its count."""
    at = np.repeat(np.arange(len(first)), count)
    return at, np.arange(len(at)) - np.repeat(_offsets(count)[:-1], count) + np.repeat(first, count)


def dictionary_repeats(t: np.ndarray, doc: np.ndarray, row: np.ndarray, lo: np.ndarray, size: np.ndarray, content: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(entry, first and last start) of strings that repeat earlier ones. Entries are contexts, ``size`` bytes of ``content`` each."""
    at = _offsets(size)[:-1]
    order = np.argsort(t, kind="stable")
    heads = np.flatnonzero(_runs(t[order]))
    total = _offsets(size[order])[np.append(heads, len(t))]
    a = 0
    while a < len(heads):
        b = max(a + 1, int(np.searchsorted(total, total[a] + ARRAY_BYTES, "right")) - 1)
        part = order[heads[a] : heads[b] if b < len(heads) else len(t)]
        a = b
        text = content[_within(at[part], size[part])[1]]
        entry, start = _within(_offsets(size[part])[:-1], size[part] - LENGTH + 1)
        place = lo[part][entry] + start - _offsets(size[part])[entry]
        ranked, head = suffix_order(text, start)
        late = _late_strings(head, ranked, doc[part][entry], row[part][entry], place)
        yield _as_runs(part[entry[late]], place[late])


def _slices(lo: np.ndarray, starts: np.ndarray, kind: np.ndarray, size: int = 1 << 14) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Phrases in runs of some MB of context, to bound the memory of very long texts."""
    for a in range(0, len(lo), size):
        yield lo[a : a + size], starts[a : a + size], kind[a : a + size]


def _first_strings(docs: DataFrame, asked: DataFrame, buckets: int) -> DataFrame:
    """Step 2: blobs of starts that go, from the suffix arrays of the asked contexts; hot triggers' strings by their fingerprints."""
    schema = arrow_schema(PHRASES, docs.sparkSession)
    flush = max(FLUSH, A_BLOB * buckets)

    def contexts(parts):
        """Blobs of contexts by trigger: bytes in ``context``, their number in ``hi``."""
        t, doc, row, lo, size, content = map(np.concatenate, zip(*parts, strict=True))
        at = _offsets(size)[:-1]
        number = np.arange(len(t))
        for b, (x,) in scatter(t, [number], buckets):
            i = np.frombuffer(x, np.int64)
            yield {"bucket": b, "kind": PHRASE, "trigger": t[i].tobytes(), "context": content[_within(at[i], size[i])[1]].tobytes(), "doc": doc[i].tobytes(), "row": row[i].tobytes(), "lo": lo[i].astype(np.int32).tobytes(), "hi": size[i].astype(np.uint8).tobytes()}

    def singles(h, h2, doc, row, lo):
        """Blobs of single strings, by fingerprint; of equal ones here, the first goes on."""
        order = np.lexsort((lo, row, doc, h2, h))
        h, h2, doc, row, lo = (x[order] for x in (h, h2, doc, row, lo))
        late = ~_runs(h, h2)
        yield from _by_doc(GONE, doc[late], row[late], lo[late], lo[late], buckets)
        columns = [x[~late] for x in (h, h2, doc, row)]
        for b, (x, y, d, r, p) in scatter(columns[0], [*columns, lo[~late].astype(np.int32)], buckets):
            yield {"bucket": b, "kind": SINGLY, "trigger": x, "context": y, "doc": d, "row": r, "lo": p}

    def look(batches):
        whole, single, n, m, size = [], [], 0, 0, 0
        for batch in batches:
            ids, rows = _ids(batch)
            asks = batch.column(3).to_pylist()
            for i, j, data, offsets in chunks(texts(batch.column(2))):
                for r in range(i, j):
                    for lo, starts, kind in _slices(*_unpack(asks[r])):
                        length, base = starts + LENGTH - 1, offsets[r - i]
                        for k, one in ((kind == ASKED, False), (kind == SINGLY, True)):
                            if not k.any():
                                continue
                            part, first = data[_within(lo[k] + base, length[k])[1]], _offsets(length[k])[:-1]
                            doc, row = np.full(k.sum(), ids[r]), np.full(k.sum(), rows[r])
                            if not one:
                                whole.append((triggers(part, first, starts[k]), doc, row, lo[k], length[k], part))
                                n += len(doc)
                                size += len(part)
                                continue
                            entry, x = _within(first, starts[k])
                            back = len(part) - x
                            single.append((span_hash(rolling(part), x, x + LENGTH), span_hash(rolling(part[::-1]), back - LENGTH, back), doc[entry], row[entry], lo[k][entry] + x - first[entry]))
                            m += len(x)
                if n >= flush or size >= 64 << 20:
                    yield _emit(list(contexts(whole)), schema)
                    whole, n, size = [], 0, 0
                if m >= flush:
                    yield _emit(list(singles(*map(np.concatenate, zip(*single, strict=True)))), schema)
                    single, m = [], 0
        if n:
            yield _emit(list(contexts(whole)), schema)
        if m:
            yield _emit(list(singles(*map(np.concatenate, zip(*single, strict=True)))), schema)

    def match(batches):
        for table, through in _passing(batches, (PHRASE, SINGLY)):
            yield from through
            if table is None:
                continue
            part = table.filter(pc.equal(table.column("kind"), PHRASE))
            if part.num_rows:
                t, doc, row, lo = blob(part, "trigger", np.uint64), blob(part, "doc", np.int64), blob(part, "row", np.int64), blob(part, "lo", np.int32).astype(np.int64)
                for entry, first, last in dictionary_repeats(t, doc, row, lo, blob(part, "hi", np.uint8).astype(np.int64), blob(part, "context", np.uint8)):
                    yield _emit(list(_by_doc(GONE, doc[entry], row[entry], first, last, buckets)), schema)
            part = table.filter(pc.equal(table.column("kind"), SINGLY))
            if part.num_rows:
                h, h2, doc, row, lo = blob(part, "trigger", np.uint64), blob(part, "context", np.uint64), blob(part, "doc", np.int64), blob(part, "row", np.int64), blob(part, "lo", np.int32).astype(np.int64)
                order = np.lexsort((h2, h))
                late = _late_strings(_runs(h[order], h2[order]), order, doc, row, lo)
                yield _emit(list(_by_doc(GONE, doc[late], row[late], lo[late], lo[late], buckets)), schema)

    joined = _with(docs, asked.where("asked is not null").select("doc", "row", "asked"), "asked", "inner").select("doc", "row", "text", "asked")
    return by_bucket(joined.mapInArrow(tidy(look), PHRASES), buckets).mapInArrow(tidy(match), PHRASES)


def _with(docs: DataFrame, by_doc: DataFrame, column: str, how: str) -> DataFrame:
    """docs joined with blobs by document; the blobs are broadcast only while their measured size is small."""
    size = by_doc.agg(F.sum(F.octet_length(column) + 40)).first()[0] or 0
    return docs.join(F.broadcast(by_doc) if size <= BROADCAST_BYTES else by_doc.hint("merge"), ["doc", "row"], how)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc, row, removed): byte ranges of each document covered by strings that start earlier, as pairs of 64-bit numbers.

    docs(doc, row, text): doc is a long, LAST for null; (doc, row) is the document. Documents that lose nothing have no row.
    """
    docs = docs.select("doc", "row", "text")
    buckets = bucket_count(plan_bytes(docs), BUCKET_BYTES)
    first = materialize(_spans(_first_contexts(docs, buckets), buckets), "phrase-spans")
    second = materialize(_spans(_first_strings(docs, first, buckets), buckets), "string-spans")
    whole = first.where("removed is not null").select("doc", "row", F.col("removed").alias("r1"))
    return whole.join(second.select("doc", "row", F.col("removed").alias("r2")), ["doc", "row"], "full").select("doc", "row", F.concat(F.coalesce("r1", F.lit(b"")), F.coalesce("r2", F.lit(b""))).alias("removed"))


def kept_pieces(text: np.ndarray, removed: bytes | None) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """The maximal removed runs of a text and the pieces between them."""
    if not removed:
        return [], [(0, len(text))]
    x = np.frombuffer(removed, np.int64).reshape(-1, 2)
    x = x[np.argsort(x[:, 0], kind="stable")]
    lo, end = _merged(x[:, 0], np.minimum(x[:, 1], len(text)))
    gone = list(zip(lo.tolist(), end.tolist(), strict=True))
    return gone, list(zip([0, *end.tolist()], [*lo.tolist(), len(text)], strict=True))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs(doc_id, text)."""
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    schema = arrow_schema(out, docs.sparkSession)
    docs = numbered(docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), "text"), "row")
    spans = materialize(repeated_spans(docs), "removed-spans")

    def digest(batches):
        for batch in batches:
            ids, removed = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            data, offsets = raw_bytes(texts(batch.column(1)))
            rows = []
            for i, doc in enumerate(ids):
                text = data[offsets[i] : offsets[i + 1]]
                gone, kept = kept_pieces(text, removed[i])
                h = hashlib.sha256()
                for a, b in kept:
                    h.update(text[a:b])
                rows.append((None if doc == LAST else doc, len(text), sum(b - a for a, b in gone), len(gone), h.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * 5, schema, strict=True)], schema=schema)

    return _with(docs, spans, "removed", "left").select("doc", "text", "removed").mapInArrow(tidy(digest), out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(read(spark, sf_dir, "documents"))


#: Bytes as pairs of hex digits; strings are grouped by their own content. Rows that share a doc_id go by their order in the table.
ORACLE_SQL = """
WITH t AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS LAST) AS o FROM (SELECT doc_id, hex(encode(COALESCE(text, ''))) AS h FROM documents)),
s AS (SELECT o, unnest(range(0, (length(h) // 2 - 99)::BIGINT)) AS p, h FROM t WHERE length(h) >= 200),
g AS (SELECT o, p, substr(h, (p * 2 + 1)::BIGINT, 200) AS w FROM s),
late AS (SELECT o, p FROM g QUALIFY row_number() OVER (PARTITION BY w ORDER BY o, p) > 1),
runs AS (SELECT o, p, CASE WHEN p <= COALESCE(lag(p) OVER (PARTITION BY o ORDER BY p) + 100, -1) THEN 0 ELSE 1 END AS fresh FROM late),
numbered AS (SELECT o, p, sum(fresh) OVER (PARTITION BY o ORDER BY p) AS k FROM runs),
spans AS (SELECT o, k, min(p) AS a, max(p) + 100 AS b FROM numbered GROUP BY o, k),
pieces AS (SELECT o, k, COALESCE(lag(b) OVER (PARTITION BY o ORDER BY k), 0) AS a, a AS b FROM spans
  UNION ALL SELECT o, max(k) + 1, max(b), NULL FROM spans GROUP BY o),
kept AS (SELECT o, string_agg(CASE WHEN b IS NULL THEN substr(h, (a * 2 + 1)::BIGINT) ELSE substr(h, (a * 2 + 1)::BIGINT, ((b - a) * 2)::BIGINT) END, '' ORDER BY k) AS h FROM pieces JOIN t USING (o) GROUP BY o),
lost AS (SELECT o, sum(b - a)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans FROM spans GROUP BY o)
SELECT doc_id, (length(t.h) // 2)::BIGINT AS n_bytes, COALESCE(n_removed, 0)::BIGINT AS n_removed, COALESCE(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(COALESCE(kept.h, t.h))) AS kept_sha256
FROM t LEFT JOIN lost USING (o) LEFT JOIN kept USING (o)"""
