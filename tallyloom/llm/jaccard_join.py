"""N-gram Jaccard join by prefix trees, and the components of its links.

A document's set holds the hashes of its distinct 5-word shingles; two sets link when 100 * intersection >= 75 * union.
Sets that are equal form one class and are handled once. All sets are ordered by one global order: shingles of a single
class first, then shared ones, then very common ones, by hash within each tier. By the prefix bound two sets can link only
if they share a shingle among the first ``n - ceil(0.75 n) + 1`` of each, so most documents, whose first shingles are all
their own, drop out before anything but counts is shuffled.

1. One text pass deals shingles out to count buckets (delta-coded blobs, 2 to 3 bytes each); the buckets return two fixed-
   size bitmaps, of shared and of common shingles. They only choose the order: a wrong bit costs time, never a link.
2. A second text pass keeps the ordered sets of the documents whose prefix reaches a shared shingle. Documents that share a
   prefix shingle are joined into blocks, which hold all pairs that can link. A task joins its own documents first and
   sends on one of them, so a shingle of a third of all documents costs a few rows a task.
3. Each block's sets go into a trie. A set is joined by walking the trie level by level: the overlap of a path is counted
   once for all sets below it, and subtrees whose remaining length cannot reach the needed overlap are cut. Sets already in
   one component are not compared again. Blocks above BLOCK_TOKENS are first cut where the shingles that prefixes share
   are too few for a link (``_cut_blocks``); those still above it are dealt into parts: all parts meet a few pivot sets,
   then every set that is not with the block's largest component meets every part, so no pair goes unseen.

Defined cases: null, empty or blank texts have an empty set, link with nothing and are their own component; every row is a
document of its own, told apart by its row key (``numbered``), so repeated and null ids do no harm; a component without any
doc_id has the component_id null; an empty table gives an empty result; extra columns are ignored, and pass through ``stage``.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, blob, BROADCAST_BYTES, bucket_count, by_bucket, chunks, groups, materialize, mix, numbered, plan_bytes, read, scatter, shingles, small_join, texts, tidy, unused, words

WIDTH = 5
NUM, DEN = 75, 100
#: Text bytes (as estimated from files) behind one count bucket, and shingles gathered by a task before it sends them on.
BUCKET_BYTES, FLUSH = 4 << 20, 3 << 19
#: Bytes of both bitmaps together, over all buckets; this much is broadcast at most.
BITMAP_BYTES = 88 << 20
#: A bucket's bitmap has 2 ** PLACE_BITS bits at most.
PLACE_BITS = 22
COMMON = 24
#: Numbers, beyond those of the buckets, under which rows of documents are dealt out.
DEALT = 4096
#: Shingles of the sets that one task joins at once.
BLOCK_TOKENS = 2_000_000
PIVOTS = 32
#: Prefix shingles of a large block that more of its sets hold than this join them without a count; pairs at once; a count beyond any bound.
LIGHT, PAIRS_AT_ONCE, SURE = 64, 1 << 21, 1 << 40
#: Shingles of sets behind one bucket of those prefixes.
CUT_TOKENS = 1 << 20
PAIR = "a long, b long"
#: Up to this many measured pairs (16 bytes each), components are found in one task; beyond it, by alternating stars.
LOCAL_EDGES = 1 << 20


def chunk_sets(column: pa.Array, width: int) -> Iterator[list[np.ndarray]]:
    """The sorted distinct shingle hashes of each text, for runs of texts."""
    for _, _, data, offsets in chunks(column):
        w, first, _ = words(data, offsets)
        h, at = shingles(w, first, width)
        yield [np.unique(h[at[k] : at[k + 1]]) for k in range(len(at) - 1)]


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    d = np.array([np.add.reduce(mix(s)), np.add.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D)))], np.uint64)
    a, b = mix(d + np.uint64(len(s))).view(np.int64).tolist()
    return a, b


def _planes(sorted_values: np.ndarray) -> bytes:
    """Deltas of sorted 32-bit values as four byte planes; the upper ones are nearly all zero and compress away."""
    deltas = np.diff(sorted_values, prepend=np.uint32(0)).astype(np.uint32)
    return deltas.view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplane(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view(np.uint32).ravel(), dtype=np.uint64).astype(np.uint32)


def bitmap_bits(buckets: int) -> int:
    """Bits of a bucket's bitmap of shared shingles: a share of BITMAP_BYTES, not rounded to a power of two; the common ones have an eighth of it."""
    return max(1 << 10, min(1 << PLACE_BITS, BITMAP_BYTES * 7 // buckets)) // 64 * 64


def _bits(values: np.ndarray, size: int) -> list[np.ndarray]:
    """Three places below ``size`` for each value, each from PLACE_BITS of its hash."""
    x, wide = mix(values.astype(np.uint64)), np.uint64(PLACE_BITS)
    return [((((x >> np.uint64(s)) & np.uint64((1 << PLACE_BITS) - 1)) * np.uint64(size)) >> wide).astype(np.int64) for s in (0, 21, 42)]


def _bitmap(values: np.ndarray, size: int) -> bytes:
    out = np.zeros(size, bool)
    for at in _bits(values, size):
        out[at] = True
    return np.packbits(out).tobytes()


def _in_bitmaps(values: np.ndarray, bucket: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Membership in the bitmap (a row of ``packed``) of each value's bucket."""
    out = np.ones(len(values), bool)
    for at in _bits(values, packed.shape[1] * 8):
        out &= (packed[bucket, at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0
    return out


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (h >> np.uint64(40)) % np.uint64(buckets)


COUNTED = "bucket int, doc_id long, row long, n long, d1 long, d2 long, content binary, common binary"


def _counted(docs: DataFrame, width: int, buckets: int, bits: int) -> DataFrame:
    """Rows of documents (with doc_id, n and digest) and of buckets (bucket and bitmaps), after one text pass and shuffle."""
    schema = arrow_schema(COUNTED, docs.sparkSession)

    def deal(batches):
        held: list[np.ndarray] = []
        size, done, seen = 0, 0, set()

        def flush():
            h = np.concatenate(held)
            for b, (data,) in scatter(h, [h.astype(np.uint32)], buckets):
                v = np.sort(np.frombuffer(data, np.uint32))
                keep = np.ones(len(v), bool)
                keep[COMMON:] = v[COMMON:] != v[:-COMMON]  # COMMON of a kind say all there is to say
                yield b, _planes(v[keep])

        def sent(found):
            found = list(found)
            n = len(found)
            none = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int32()), none, none, none, none, none, pa.array([x for _, x in found], pa.binary()), pa.nulls(n, pa.binary())], schema=schema)

        for batch in batches:
            n, d1, d2 = [], [], []
            for s in (s for sets in chunk_sets(texts(batch.column(2)), width) for s in sets):
                a, b = digest(s)
                n.append(len(s))
                d1.append(a)
                d2.append(b)
                if (a, b) not in seen:
                    seen.add((a, b))
                    held.append(s)
                    size += len(s)
                if size >= FLUSH:
                    yield from sent(flush())
                    held, size = [], 0
            k = len(n)  # rows of documents are dealt out in turn, whatever their content
            yield pa.RecordBatch.from_arrays([pa.array((buckets + np.arange(done, done + k) % DEALT).astype(np.int32)), batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary())], schema=schema)
            done += k
        if size:
            yield from sent(flush())

    def count(batches):
        def documents():
            for batch in batches:
                content = batch.column(6)
                is_doc = content.is_null()
                docs_here = batch.filter(is_doc)
                if docs_here.num_rows:
                    ready.append(docs_here)
                yield batch.filter(content.is_valid())

        ready: list[pa.RecordBatch] = []
        for b, table in groups(documents()):
            while ready:
                yield ready.pop()
            v = np.sort(np.concatenate([_unplane(x) for x in table.column("content").to_pylist()]))
            shared = np.unique(v[1:][v[1:] == v[:-1]])
            often = np.unique(v[COMMON - 1 :][v[COMMON - 1 :] == v[: len(v) - COMMON + 1]]) if len(v) >= COMMON else v[:0]
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), *[pa.nulls(1, pa.int64())] * 5, pa.array([_bitmap(shared, bits)], pa.binary()), pa.array([_bitmap(often, max(8, bits // 8))], pa.binary())], schema=schema)
        while ready:
            yield ready.pop()

    return by_bucket(docs.select("doc_id", "row", "text").mapInArrow(tidy(deal), COUNTED), buckets).mapInArrow(tidy(count), COUNTED)


def _pack(ordered: np.ndarray, own: int, shared: int) -> bytes:
    """The upper 48 bits of a set's shingles as byte planes of deltas within each tier; about five bytes each compressed."""
    v = ordered >> np.uint64(16)
    deltas = np.diff(v, prepend=np.uint64(0))
    for at in (own, own + shared):
        if at < len(v):
            deltas[at] = v[at]
    return deltas.view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes()


def _unpack(data: bytes, own: int, shared: int) -> np.ndarray:
    planes = np.zeros((len(data) // 6, 8), np.uint8)
    planes[:, :6] = np.frombuffer(data, np.uint8).reshape(6, -1).T
    deltas = planes.view(np.uint64).ravel()
    parts = np.split(deltas, [own, own + shared])
    return np.concatenate([np.cumsum(x, dtype=np.uint64) for x in parts]) << np.uint64(16)


SETS = "node long, n long, own long, shared long, tokens binary"


def _sets(docs: DataFrame, width: int, bitmaps, buckets: int) -> DataFrame:
    """Ordered sets whose prefix reaches a shared shingle: ``own`` and ``shared`` count the first two tiers."""
    schema = arrow_schema(SETS, docs.sparkSession)

    def keep(batches):
        shared_bits, common_bits = bitmaps.value
        seen: set[tuple[int, int]] = set()

        def ordered(sets):
            h = np.concatenate(sets)
            bucket, v = _bucket(h, buckets).astype(np.int64), h.astype(np.uint32)
            tiers = _in_bitmaps(v, bucket, shared_bits) * (1 + _in_bitmaps(v, bucket, common_bits)).astype(np.int8)
            at = 0
            for s in sets:
                n, tier = len(s), tiers[at : at + len(s)]
                at += n
                own, shared = int((tier == 0).sum()), int((tier == 1).sum())
                if n and own < n - -(-NUM * n // DEN) + 1 and (d := digest(s)) not in seen:
                    seen.add(d)
                    yield d[0], n, own, shared, _pack(s[np.argsort(tier, kind="stable")], own, shared)

        for batch in batches:
            for sets in chunk_sets(texts(batch.column(0)), width):
                out = list(ordered(sets))
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in out], schema=schema)

    return docs.select("text").mapInArrow(tidy(keep), SETS)


def _can_link(nx, ny, px, py):
    """Whether sets of these sizes that share the shingle at these places (none before it) can reach the needed overlap."""
    need = -(-NUM * (nx + ny) // (NUM + DEN))
    return (np.minimum(nx, ny) * DEN >= NUM * np.maximum(nx, ny)) & (1 + np.minimum(nx - px - 1, ny - py - 1) >= need)


def _grouped(token: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of distinct (token, node) by both, and where each token starts in it and how often it stands there."""
    order = np.lexsort((node, token))
    token, node = token[order], node[order]
    fresh = np.ones(len(token), bool)
    fresh[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
    order, token = order[fresh], token[fresh]
    starts = np.flatnonzero(np.diff(token, prepend=~token[:1])) if len(token) else np.zeros(0, np.int64)
    return order, starts, np.diff(np.append(starts, len(token)))


def _block_pairs(sets: DataFrame, buckets: int) -> DataFrame:
    """Pairs that join all documents which share a prefix shingle: for each shingle, its documents and the first of them."""
    spark = sets.sparkSession
    kind = "bucket int, token binary, node binary, n binary, place binary, a binary, b binary"
    schema, pair = arrow_schema(kind, spark), arrow_schema(PAIR, spark)

    def deal(batches):
        for batch in batches:
            tokens, nodes, sizes, places = [], [], [], []
            for node, n, own, shared, t in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                prefix = _unpack(t, own, shared)[own : n - -(-NUM * n // DEN) + 1]
                tokens.append(prefix)
                nodes.append(np.full(len(prefix), node, np.int64))
                sizes.append(np.full(len(prefix), n, np.int64))
                places.append(own + np.arange(len(prefix)))
            if not tokens:
                continue
            token, node, n, place = map(np.concatenate, (tokens, nodes, sizes, places))
            order, starts, counts = _grouped(token, node)
            token, node, n, place = token[order], node[order], n[order], place[order]
            head = np.repeat(starts, counts)
            many = np.repeat(counts, counts) > 2
            a, b = node[many], node[head][many]
            ab = np.unique(np.stack([a, b], 1)[a != b], axis=0) if many.any() else np.zeros((0, 2), np.int64)
            send = ~many | (head == np.arange(len(head)))
            n = np.where(many, 0, n)  # stands for others too: no bound holds
            found = [(bucket, *cols, None, None) for bucket, cols in scatter(token[send], [token[send], node[send], n[send].astype(np.int32), place[send].astype(np.int32)], buckets)]
            if len(ab):
                found.append((int(ab[0, 0] % buckets), None, None, None, None, ab[:, 0].tobytes(), ab[:, 1].tobytes()))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in found], schema=schema)

    def meet(batches):
        for _, table in groups(batches):
            a, b = blob(table, "a", np.int64), blob(table, "b", np.int64)
            token, node = blob(table, "token", np.uint64), blob(table, "node", np.int64)
            n, place = blob(table, "n", np.int32).astype(np.int64), blob(table, "place", np.int32).astype(np.int64)
            if len(token):
                order, starts, counts = _grouped(token, node)
                node, n, place = node[order], n[order], place[order]
                head = np.repeat(starts, counts)
                go = np.arange(len(head)) != head
                two = go & (np.repeat(counts, counts) == 2) & (n > 0) & (n[head] > 0)
                go[two] = _can_link(n[two], n[head][two], place[two], place[head][two])
                a, b = np.append(a, node[go]), np.append(b, node[head][go])
            ab = np.unique(np.stack([a, b], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0].copy()), pa.array(ab[:, 1].copy())], schema=pair)

    return by_bucket(sets.mapInArrow(tidy(deal), kind), buckets).mapInArrow(tidy(meet), PAIR).distinct()


def _local_components(edges: DataFrame) -> DataFrame:
    """The same for at most LOCAL_EDGES (measured) pairs, by union-find in one task of an executor."""
    kind = "node long, component long"
    schema = arrow_schema(kind, edges.sparkSession)

    def unite(batches):
        root: dict[int, int] = {}

        def top(x):
            while (y := root.setdefault(x, x)) != x:
                root[x] = root[y]
                x = y
            return x

        for batch in batches:
            for a, b in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                a, b = top(a), top(b)
                if a != b:
                    root[max(a, b)] = min(a, b)
        nodes = list(root)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], schema=schema)

    return edges.coalesce(1).mapInArrow(tidy(unite), kind)


def components(pairs: DataFrame, limit: int = 60) -> DataFrame:
    """(node, component) for all nodes of pairs(a, b); component: the smallest node. Alternates large and small stars."""
    edges = materialize(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    if edges.count() <= LOCAL_EDGES:
        return _local_components(edges)
    state = None
    for _ in range(limit):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b"))).distinct()
        edges = materialize(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


class Trie:
    """Path-compressed prefix tree of rank sequences; nodes hold a slice of one of the sets below them."""

    def __init__(self, ranks: list[np.ndarray]):
        self.order = sorted(range(len(ranks)), key=lambda i: ranks[i].astype(">u4").tobytes())
        seqs = [ranks[i] for i in self.order]
        m = len(seqs)
        self.flat = np.concatenate(seqs)
        self.base = np.concatenate([[0], np.cumsum([len(s) for s in seqs])])
        lcp = np.zeros(m, np.int64)
        for i in range(1, m):
            k = min(len(seqs[i - 1]), len(seqs[i]))
            differ = np.flatnonzero(seqs[i - 1][:k] != seqs[i][:k])
            lcp[i] = differ[0] if len(differ) else k
        size = np.diff(self.base)
        nodes: list[tuple] = []  # parent, first and end of its slice in flat, depth at its end, sizes below, leaf
        stack = [(0, m, 0, -1)]
        while stack:
            a, b, d, parent = stack.pop()
            single = b - a == 1
            end = int(size[a]) if single else int(lcp[a + 1 : b].min())
            shortest, longest = int(size[a:b].min()), int(size[a:b].max())
            # long slices become chains of nodes, so that a walk can stop within them
            step = max(8, longest * (DEN - NUM) * 6 // (DEN * 10))
            while end - d > step:
                nodes.append((parent, self.base[a] + d, self.base[a] + d + step, d + step, shortest, longest, -1))
                parent, d = len(nodes) - 1, d + step
            me = len(nodes)
            nodes.append((parent, self.base[a] + d, self.base[a] + end, end, shortest, longest, a if single else -1))
            if single:
                continue
            cuts = [a, *(a + 1 + np.flatnonzero(lcp[a + 1 : b] == end)).tolist(), b]
            stack += [(x, y, end, me) for x, y in zip(cuts, cuts[1:], strict=False)]
        self.parent, self.start, self.end, self.depth, self.low, self.high, self.leaf = np.array(nodes, np.int64).T
        kids = np.argsort(self.parent, kind="stable")
        self.kids = kids[1:]  # without the root, whose parent is -1
        self.first_kid = np.searchsorted(self.parent[kids][1:], np.arange(len(nodes) + 1))

    def links(self, q: np.ndarray, present: np.ndarray) -> np.ndarray:
        """Indices of the sets that link with q; present: scratch array of all ranks, zero on entry and exit."""
        present[q] = 1
        n, at, over, found = len(q), np.zeros(1, np.int64), np.zeros(1, np.int64), []
        while len(at):
            length = self.end[at] - self.start[at]
            cum = np.concatenate([[0], np.cumsum(length)])
            where = np.arange(cum[-1]) + np.repeat(self.start[at] - cum[:-1], length)
            hits = np.concatenate([[0], np.cumsum(present[self.flat[where]])])
            over = over + hits[cum[1:]] - hits[cum[:-1]]
            # At best all that remains of the longest set below is shared; at least the shortest must be matched by q.
            best = np.minimum(over + self.high[at] - self.depth[at], n)
            ok = ((NUM + DEN) * (over + self.high[at] - self.depth[at]) >= NUM * (n + self.high[at])) & ((NUM + DEN) * best >= NUM * (n + self.low[at]))
            at, over = at[ok], over[ok]
            done = self.leaf[at] >= 0
            found += self.leaf[at[done]].tolist()
            at, over = at[~done], over[~done]
            fan = self.first_kid[at + 1] - self.first_kid[at]
            cum = np.concatenate([[0], np.cumsum(fan)])
            over = np.repeat(over, fan)
            at = self.kids[np.arange(cum[-1]) + np.repeat(self.first_kid[at] - cum[:-1], fan)]
        present[q] = 0
        return np.array([self.order[i] for i in found], np.int64)


def trie_links(sets: list[np.ndarray], tiers: list[np.ndarray], queries: list[int]) -> list[tuple[int, int]]:
    """A spanning set of the links between the query sets and all sets; sets are in the global order given by (tier, hash)."""
    flat, tier = np.concatenate(sets), np.concatenate(tiers)
    value, inverse = np.unique(flat, return_inverse=True)
    value_tier = np.zeros(len(value), np.int8)
    value_tier[inverse] = tier
    rank = np.empty(len(value), np.int64)
    rank[np.lexsort((value, value_tier))] = np.arange(len(value))
    cuts = np.cumsum([len(s) for s in sets])[:-1]
    ranks = np.split(rank[inverse], cuts)
    trie, present = Trie(ranks), np.zeros(len(value), np.int64)
    root = list(range(len(sets)))

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out, parts = [], len(sets)
    for q in queries:
        if parts == 1:
            break
        for j in trie.links(ranks[q], present).tolist():
            a, b = top(q), top(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                parts -= 1
                out.append((q, j))
    return out


def _pairs_of(starts: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs within runs, about PAIRS_AT_ONCE at a time."""
    done = np.cumsum(counts * (counts - 1) // 2) // PAIRS_AT_ONCE
    for a, b in itertools.pairwise([0, *(np.flatnonzero(np.diff(done)) + 1).tolist(), len(counts)]):
        first, end = starts[a:b], starts[a:b] + counts[a:b]
        at, end = np.arange(counts[a:b].sum()) + np.repeat(first - np.cumsum(counts[a:b]) + counts[a:b], counts[a:b]), np.repeat(end, counts[a:b])
        found, step = [], 1
        while len(at := at[(go := at + step < end)]):
            end = end[go]
            found.append((at, at + step))
            step += 1
        if found:
            yield np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


CUT = "a long, b long, na int, nb int, k long"


def _cut_blocks(held: DataFrame, weight: int) -> DataFrame:
    """Pairs that join what may link of the blocks' sets: a rare shingle that two prefixes share by chance joins nothing.

    A shingle of at most LIGHT prefixes gives all its pairs, and a pair counts the shingles that its prefixes share. Where
    one prefix ends first, all of its set but what follows is known, so the overlap is the count and that rest at most.
    A shingle of more prefixes is not counted: it joins its sets from size to size, and adds to the bound of each.
    """
    schema = arrow_schema(CUT, held.sparkSession)
    kind = "bucket int, token binary, node binary, n binary"
    dealt = arrow_schema(kind, held.sparkSession)
    buckets = bucket_count(weight, CUT_TOKENS)

    def deal(batches):
        for batch in batches:
            tokens, nodes, sizes = [], [], []
            for node, n, own, shared, t in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                prefix = _unpack(t, own, shared)[own : n - -(-NUM * n // DEN) + 1]
                tokens.append(prefix)
                nodes.append(np.full(len(prefix), node, np.int64))
                sizes.append(np.full(len(prefix), n, np.int32))
            if tokens:
                token, node, n = map(np.concatenate, (tokens, nodes, sizes))
                yield pa.RecordBatch.from_pylist([dict(zip(dealt.names, (bucket, *cols), strict=True)) for bucket, cols in scatter(token, [token, node, n], buckets)], schema=dealt)

    def rows(a, b, na, nb, k):
        return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip((a, b, na, nb, k), schema, strict=True)], schema=schema)

    def meet(batches):
        for _, table in groups(batches):
            token, node, n = blob(table, "token", np.uint64), blob(table, "node", np.int64), blob(table, "n", np.int32).astype(np.int64)
            order, starts, counts = _grouped(token, node)
            node, n = node[order], n[order]
            light = counts <= LIGHT
            for x, y in _pairs_of(starts[light], counts[light]):
                near = np.minimum(n[x], n[y]) * DEN >= NUM * np.maximum(n[x], n[y])
                x, y = x[near], y[near]
                by = np.lexsort((node[y], node[x]))
                x, y = x[by], y[by]
                fresh = np.flatnonzero((np.diff(node[x], prepend=~node[x][:1]) != 0) | (np.diff(node[y], prepend=~node[y][:1]) != 0))
                if len(fresh):
                    yield rows(node[x][fresh], node[y][fresh], n[x][fresh], n[y][fresh], np.diff(np.append(fresh, len(x))))
            heavy = np.repeat(~light, counts)
            if heavy.any():
                group, node, n = np.repeat(np.arange(len(counts)), counts)[heavy], node[heavy], n[heavy]
                by = np.lexsort((node, n, group))
                x, y = by[:-1], by[1:]
                near = (group[x] == group[y]) & (n[x] * DEN >= NUM * n[y])
                x, y = x[near], y[near]
                yield rows(np.minimum(node[x], node[y]), np.maximum(node[x], node[y]), n[x], n[y], np.full(len(x), SURE))
                own, often = np.unique(node, return_counts=True)
                yield rows(own, own, 0 * own, 0 * own, often)

    sets = held.select("node", "n", "own", "shared", "tokens")
    met = by_bucket(sets.mapInArrow(tidy(deal), kind), buckets).mapInArrow(tidy(meet), CUT)
    counted = materialize(met.groupBy("a", "b").agg(F.max("na").alias("na"), F.max("nb").alias("nb"), F.sum("k").alias("k")), "shared-prefixes")
    often = materialize(counted.where("a = b").select("a", "k"), "heavy-shingles")
    more, pairs = often.count(), counted.where("a < b")
    for end in ("a", "b"):
        pairs = small_join(pairs, often.select(F.col("a").alias(end), F.col("k").alias(f"k{end}")), [end], "left", 16, more)
    most = F.greatest("na", "nb")
    bound = F.col("k") + F.least(F.coalesce("ka", F.lit(0)), F.coalesce("kb", F.lit(0))) + F.ceil(most * NUM / DEN) - 1
    return pairs.where(bound * (NUM + DEN) >= NUM * (F.col("na") + F.col("nb"))).select("a", "b")


def _join_task(tasks: DataFrame) -> DataFrame:
    """Links found in each task; tasks(task, node, n, own, shared, tokens, asks). A node may come twice (copies of a class)."""
    schema = arrow_schema(PAIR, tasks.sparkSession)

    def run(batches):
        for _, table in groups(batches, "task"):
            rows: dict[int, tuple] = {}
            for node, n, own, shared, t, asks in zip(*(table.column(c).to_pylist() for c in ("node", "n", "own", "shared", "tokens", "asks")), strict=True):
                rows[node] = (n, own, shared, t, asks or (node in rows and rows[node][4]))
            if len(rows) < 2:
                continue
            nodes = sorted(rows)
            sets = [_unpack(rows[x][3], rows[x][1], rows[x][2]) for x in nodes]
            tiers = [np.repeat(np.array([0, 1, 2], np.int8), [rows[x][1], rows[x][2], rows[x][0] - rows[x][1] - rows[x][2]]) for x in nodes]
            found = trie_links(sets, tiers, [i for i, x in enumerate(nodes) if rows[x][4]])
            yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i, _ in found], pa.int64()), pa.array([nodes[j] for _, j in found], pa.int64())], schema=schema)

    columns = ["task", "node", "n", "own", "shared", "tokens", "asks"]
    return tasks.select(*columns).repartition("task").sortWithinPartitions("task").mapInArrow(tidy(run), PAIR)


def _held(sets: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sets with their blocks, and (block, weight)."""
    held = small_join(sets, blocks.withColumnRenamed("component", "block"), ["node"], "inner", 16)
    return held, materialize(held.groupBy("block").agg(F.sum("n").alias("weight")), "block-sizes")


def _links(sets: DataFrame, blocks: DataFrame) -> DataFrame:
    """All links between sets of a block, up to those that follow from others by reachability."""
    held, sizes = _held(sets, blocks)
    large = sizes.where(F.col("weight") > BLOCK_TOKENS)
    over = large.agg(F.sum("weight")).first()[0]
    if over:
        # A large block is mostly sets that share a shingle by chance with the next one; all that can link stays together.
        cut = components(_cut_blocks(small_join(held, large.select("block"), ["block"], "inner", 16), over))
        small = small_join(blocks, large.select(F.col("block").alias("component")), ["component"], "left_anti", 16)
        blocks = materialize(small.select("node", "component").unionByName(cut), "cut-blocks")
        held, sizes = _held(sets, blocks)
    large = sizes.where(F.col("weight") > BLOCK_TOKENS).withColumn("parts", F.ceil(F.col("weight") * 2 / BLOCK_TOKENS).cast("int"))
    small = small_join(held, large.select("block"), ["block"], "left_anti", 16)
    links = _join_task(small.select("*", F.col("block").alias("task"), F.lit(True).alias("asks")))
    if large.isEmpty():
        return links
    held = small_join(held, large.select("block", "parts"), ["block"], "inner", 24)
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    pivots = _pivots(held.withColumn("order", F.xxhash64(F.lit("pivot"), "node")))

    def against(asking: DataFrame, tag: str) -> DataFrame:
        """Every asking set meets every part of its block; asking sets are dealt to groups of bounded size."""
        asking = asking.withColumn("g", F.pmod(F.xxhash64(F.lit("ask"), "node"), F.col("groups")))
        each = asking.select("block", "g", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "node", "n", "own", "shared", "tokens", F.lit(True).alias("asks"))
        gs = asking.select("block", "groups").distinct()
        others = held.withColumn("part", part).join(gs, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("g"), "part", "node", "n", "own", "shared", "tokens", F.lit(False).alias("asks"))
        return materialize(_join_task(each.unionByName(others).withColumn("task", F.xxhash64("block", "g", "part"))), tag)

    first = against(pivots.withColumn("groups", F.lit(1)), "pivot-links")
    comp = components(first)
    members = held.select("node", "block", "n").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    main = members.groupBy("block", "component").agg(F.sum("n").alias("w")).groupBy("block").agg(F.max_by("component", "w").alias("main"))
    rest = materialize(members.join(main, "block").where("component <> main").select("node").distinct(), "rest")
    asking = small_join(held, rest, ["node"], "inner", 16)
    weight = asking.groupBy("block").agg(F.ceil(F.sum("n") * 2 / BLOCK_TOKENS).cast("int").alias("groups"))
    second = against(asking.join(weight, "block"), "rest-links")
    return links.union(first).union(second)


def _pivots(ordered: DataFrame) -> DataFrame:
    """PIVOTS sets of each block: the first by hash of each of PIVOTS hash classes."""
    fields = ("node", "n", "own", "shared", "tokens", "parts")
    return ordered.groupBy("block", F.pmod(F.col("order"), F.lit(PIVOTS)).alias("k")).agg(F.min_by(F.struct(*fields), "order").alias("p")).select("block", *(F.col(f"p.{f}").alias(f) for f in fields))


def jaccard_members(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(row, doc_id, n, part, component_id) for every row of docs(row, doc_id, text).

    part names the component (null: an empty set, linked with nothing), component_id is its smallest doc_id.
    """
    spark = docs.sparkSession
    docs = docs.select("row", F.col("doc_id").cast("long").alias("doc_id"), "text")
    buckets = min(1 << 16, bucket_count(plan_bytes(docs), BUCKET_BYTES))
    bits = bitmap_bits(buckets)
    counted = materialize(_counted(docs, width, buckets, bits), "shingle-counts")
    ids = counted.where("n is not null").select("row", "doc_id", "n", "d1", "d2")
    # At most BITMAP_BYTES in all, whatever the input.
    shared_bits, common_bits = np.zeros((buckets, bits // 8), np.uint8), np.zeros((buckets, max(8, bits // 8) // 8), np.uint8)
    for r in counted.where("content is not null").select("bucket", "content", "common").toLocalIterator():
        shared_bits[r["bucket"]], common_bits[r["bucket"]] = np.frombuffer(r["content"], np.uint8), np.frombuffer(r["common"], np.uint8)
    maps = (shared_bits, common_bits)
    classes = materialize(ids.where("n > 0").groupBy("d1", "d2").agg(F.min("row").alias("first"), F.min("doc_id").alias("least"), F.count("*").alias("copies")), "classes")
    total = classes.agg(F.sum("copies"), F.sum(F.col("copies") - 1)).first()
    # Copies need not be read twice: all rows of a class but one are left out, where they are few enough to be sent along.
    repeated = classes.where("copies > 1").select("d1", "d2", "first", "copies")
    read_again = docs
    if (total[1] or 0) * 16 <= BROADCAST_BYTES:
        spare = materialize(_to_classes(ids.select("row", "d1", "d2"), repeated, total[0] or 0).where("row <> first").select("row"), "copies")
        read_again = docs.join(F.broadcast(spare), "row", "left_anti")
    sets = materialize(_sets(read_again, width, spark.sparkContext.broadcast(maps), buckets), "shingle-sets")
    blocks = components(_block_pairs(sets, buckets))
    linked = components(_links(sets, blocks))
    with_links = classes.join(linked, classes["d1"] == linked["node"])
    least = with_links.groupBy("component").agg(F.min("least").alias("component_id"))
    named = with_links.join(least, "component").select("d1", "d2", F.col("component").alias("part"), "component_id")
    known = classes.join(named, ["d1", "d2"], "left").select("d1", "d2", "copies", F.coalesce("part", "d1").alias("part"), F.coalesce("component_id", "least").alias("component_id"))
    of_class = _to_classes(ids.where("n > 0"), known, total[0] or 0).select("row", "doc_id", "n", "part", "component_id")
    return of_class.unionByName(ids.where("n = 0").select("row", "doc_id", "n", F.lit(None).cast("long").alias("part"), F.col("doc_id").alias("component_id")))


def _to_classes(ids: DataFrame, classes: DataFrame, rows: int) -> DataFrame:
    """ids joined with their classes by (d1, d2), though one class may hold a third of all rows.

    Classes of more copies than a share of the rows that lets no more than BROADCAST_BYTES of them be that large are sent
    to all tasks; what is left has no key of more rows than that.
    """
    many = max(64, -(-rows * 64 // BROADCAST_BYTES))
    large, small = classes.where(F.col("copies") > many).drop("copies"), classes.where(F.col("copies") <= many).drop("copies")
    mark = ids.join(F.broadcast(large.select("d1", "d2", F.lit(True).alias("is_large"))), ["d1", "d2"], "left")
    apart = mark.where("is_large").drop("is_large").join(F.broadcast(large), ["d1", "d2"], "inner")
    return apart.unionByName(mark.where("is_large is null").drop("is_large").join(small, ["d1", "d2"]))


def jaccard_components(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs(doc_id, text)."""
    found = jaccard_members(numbered(docs.select("doc_id", "text"), "row"), width)
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row of each component stays: that with the smallest doc_id (null last), then row key. Empty sets stay."""
    row = unused("row", docs.columns)
    keyed = numbered(docs, row)
    found = materialize(jaccard_members(keyed.select(F.col(row).alias("row"), "doc_id", "text")), "near-copies")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    stays = found.where("part is not null").groupBy("part").agg(F.min(place).alias("p")).select("p.row")
    gone = found.where("part is not null").select("row").join(stays, "row", "left_anti").select(F.col("row").alias(row))
    return small_join(keyed, materialize(gone, "copies-gone"), [row], "left_anti", 16).select(*docs.columns)


#: Components of docs(row_no, doc_id, text) by recursion over all links; for small tables.
COMPONENTS_SQL = r"""
op2_words AS (SELECT row_no, doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM numbered2),
op2_sets AS (SELECT row_no, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM op2_words),
op2_grams AS (SELECT row_no, len(s) AS n, unnest(s) AS g FROM op2_sets),
op2_pairs AS (SELECT a.row_no AS a, b.row_no AS b FROM op2_grams a JOIN op2_grams b ON a.g = b.g AND a.row_no <> b.row_no AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
  GROUP BY a.row_no, b.row_no, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
op2_reach AS (SELECT row_no AS a, row_no AS b FROM numbered2 UNION SELECT r.a, p.b FROM op2_reach r JOIN op2_pairs p ON r.b = p.a)"""

ORACLE_SQL = "WITH RECURSIVE numbered2 AS (SELECT *, row_number() OVER () AS row_no FROM documents)," + COMPONENTS_SQL + """
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id FROM op2_sets s
JOIN (SELECT r.a, min(n.doc_id) AS component_id FROM op2_reach r JOIN numbered2 n ON r.b = n.row_no GROUP BY r.a) c ON c.a = s.row_no"""
