"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into passages of two blocks of BLOCK words (each block belongs to two passages). A passage is a TF-IDF vector
over SLOTS hashed word pairs, folded with signs into DIMS numbers. Two passes over all documents sum, per task, the pairs'
document frequencies and the product of the passages' Gram matrix with a random matrix; neither depends on the benchmark.
With the benchmark's own passages, weighted up so that the space resolves them, the randomised decomposition (Nystroem's,
with a small SVD) gives the right singular vectors of the weighted passages; those with a singular value of CUT of the largest
stay, RANK at most. Another pass projects every passage; those with enough energy in the space and enough cosine to an item
become candidates. A space of bounded rank doesn't resolve thousands of items; therefore passages that hold enough of an
item's rarest words become candidates as well. That test is exact: nothing that can pass the next one fails it. A candidate
counts when the longest common subsequence of words, over the passage and its surroundings, covers LCS_FROM of the item and
its answer (the part after "Answer:", else the last sentence) is there as well. The cosine in the result may be low where
the space doesn't resolve the item; ``latent`` says whether the latent search had proposed the document for it.

Benchmark items are the stated query set: they meet all passages, in blocks of QUERY_ITEMS items (one pass each); nothing of
the documents goes to the driver but the summed matrices, whose size is fixed. Sums are made in a fixed order. Defined cases:
null, empty or wordless texts and items match nothing; items of one word match nothing; repeated documents are matched
one by one, repeated items once; empty tables give an empty result; extra columns are ignored or pass through ``stage``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, chunks, materialize, mix, read, texts, tidy
from .toxicity import terms

BLOCK = 32
SLOTS, DIMS = 1 << 20, 1 << 13
#: Directions kept at most, random ones beyond them, and the least singular value kept, as a part of the largest.
RANK, MORE, CUT = 48, 8, 0.01
SLICES = 32
#: Tasks that make sums at most, so that what they send is bounded, and parts that are added up at a time.
SUM_TASKS, FAN_IN = 8192, 64
QUERY_ITEMS = 4096
#: The benchmark's share of the squared weights of the decomposed matrix, against 1 for all documents.
BENCH_WEIGHT = 8.0
ENERGY_FROM, COSINE_FROM = 0.09, 0.5
LCS_FROM, ANSWER_FROM = 0.6, 0.5
#: The part of the words a match needs that must be among the item's indexed (rarest) ones; more: longer lists, fewer candidates.
RARE_PART = 0.3
SIEVE = 1 << 20
SEED = 11


def pairs(w: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slot, block) of each word pair of a run of texts; blocks are numbered through the run, one text after another."""
    count = np.diff(first)
    blocks = np.maximum(1, -(-count // BLOCK))
    base = np.concatenate([[0], np.cumsum(blocks)])
    doc = np.repeat(np.arange(len(count)), count)
    block = base[doc] + (np.arange(len(w)) - first[doc]) // BLOCK
    inner = doc[1:] == doc[:-1]
    slot = (mix(w[:-1] * np.uint64(0x9E3779B97F4A7C15) + w[1:]) & np.uint64(SLOTS - 1)).astype(np.int64)
    return slot[inner], block[:-1][inner]


def block_base(first: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.maximum(1, -(-np.diff(first) // BLOCK)))])


def passage_sums(per_block: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Sums of each block and the next one of the same text."""
    out = per_block.copy()
    follows = np.ones(len(per_block), bool)
    follows[base[1:] - 1] = False
    at = np.flatnonzero(follows)
    out[at] += per_block[at + 1]
    return out


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct numbers of x (from 0 on), ascending; np.unique goes through a hash table, which takes longer."""
    x = np.sort(x)
    return x[np.diff(x, prepend=-1) != 0]


def signed(idf: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(dimension, weight) of pairs: slots fold into dimensions with signs, so that chance meetings cancel on average."""
    return slot & (DIMS - 1), np.where(slot & DIMS, idf[slot], -idf[slot])


def _sums(table: np.ndarray, row: np.ndarray, weight: np.ndarray, group: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weighted sums of table rows over pieces of a group, each group, its first piece); groups ascend, a piece has ``piece`` rows at most."""
    head = np.flatnonzero(np.diff(group, prepend=-1))
    count = np.diff(np.append(head, len(group)))
    many = -(-count // piece)
    first = np.cumsum(many) - many
    place = np.repeat(first * piece - head, count) + np.arange(len(group))
    rows, weights = np.zeros(many.sum() * piece, np.int64), np.zeros(many.sum() * piece, np.float32)
    rows[place], weights[place] = row, weight
    # small matrix products, which are faster than sums of sorted rows
    return np.matmul(weights.reshape(-1, 1, piece), table[rows].reshape(-1, piece, table.shape[1]))[:, 0], group[head], first


def _rowsum(table: np.ndarray, dim: np.ndarray, weight: np.ndarray, block: np.ndarray, n: int) -> np.ndarray:
    """Weighted sums of table rows by block; blocks ascend and have BLOCK pairs at most."""
    out = np.zeros((n, table.shape[1]), np.float32)
    if len(dim):
        sums, at, _ = _sums(table, dim, weight, block, BLOCK)
        out[at] = sums
    return out


def _summed(docs: DataFrame, shape: tuple[int, int], add_up) -> np.ndarray:
    """Sum over all tasks of the arrays that ``add_up(batches)`` gives for docs(text), always in the same order.

    Beyond SUM_TASKS partitions a task sums up several, and no step holds more than 128 parts of a slice.
    """
    kind = "slice int, fan int, task int, part binary"
    schema = arrow_schema(kind, docs.sparkSession)
    rows = shape[0] // SLICES

    def partial(batches):
        total = add_up(batches)
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([task // FAN_IN] * SLICES, pa.int32()), pa.array([task] * SLICES, pa.int32()), pa.array([total[i * rows : (i + 1) * rows].tobytes() for i in range(SLICES)], pa.binary())], schema=schema)

    def add(key, pdf):
        import pandas as pd

        ordered = pdf.sort_values("task")
        total = sum(np.frombuffer(x, np.float64) for x in ordered["part"])
        return pd.DataFrame({"slice": [int(key[0])], "task": [int(ordered["task"].iloc[0])], "part": [total.tobytes()]})

    # at most SUM_TASKS / FAN_IN parts a slice are left for the second step
    parts = docs.select("text").coalesce(SUM_TASKS).mapInArrow(tidy(partial), kind).groupBy("slice", "fan").applyInPandas(add, "slice int, task int, part binary")
    found = {r["slice"]: np.frombuffer(r["part"], np.float64) for r in parts.groupBy("slice").applyInPandas(add, "slice int, task int, part binary").collect()}
    return np.concatenate([found[i] for i in range(SLICES)]).reshape(shape) if found else np.zeros(shape)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, float]:
    """(blocks that hold a pair, by slot; number of blocks) over all documents."""

    def count(batches):
        total = np.zeros((SLOTS + SLICES, 1))
        for batch in batches:
            for _, _, data, offsets in chunks(texts(batch.column(0))):
                w, first = terms(data, offsets)
                n = int(block_base(first)[-1])
                total[SLOTS] += n
                if len(w) > 1:
                    slot, block = pairs(w, first)
                    held = distinct(slot * n + block) // n  # ascending
                    head = np.flatnonzero(np.diff(held, prepend=-1))
                    total[held[head], 0] += np.diff(np.append(head, len(held)))
        return total

    # the rows beyond SLOTS hold the number of blocks
    total = _summed(docs, (SLOTS + SLICES, 1), count)[:, 0]
    return total[:SLOTS], float(total[SLOTS])


class Sketch:
    """What the spaces need of the documents: inverse document frequencies, and the Gram matrix times random directions."""

    def __init__(self, docs: DataFrame):
        df, n = document_frequencies(docs)
        self.idf = (np.log((n + 1) / (df + 1)) + 0.05).astype(np.float32)
        self.omega = np.random.default_rng(SEED).standard_normal((DIMS, RANK + MORE))
        sent = docs.sparkSession.sparkContext.broadcast((self.idf, self.omega.astype(np.float32)))

        def product(batches):
            idf, omega = sent.value
            total = np.zeros((DIMS, omega.shape[1]))
            for batch in batches:
                for _, _, data, offsets in chunks(texts(batch.column(0))):
                    w, first = terms(data, offsets)
                    if len(w) < 2:
                        continue
                    base = block_base(first)
                    n = int(base[-1])
                    slot, block = pairs(w, first)
                    dim, weight = signed(idf, slot)
                    z = passage_sums(_rowsum(omega, dim, weight, block, n), base)
                    both = z.copy()
                    follows = np.ones(n, bool)
                    follows[base[:-1]] = False
                    at = np.flatnonzero(follows)
                    both[at] += z[at - 1]
                    if not len(dim):
                        continue
                    order = np.argsort(dim * n + block)
                    sums, at, first_piece = _sums(both, block[order], weight[order], dim[order], 8)
                    total[at] += np.add.reduceat(sums, first_piece, axis=0)
            return total

        self.gram = _summed(docs, self.omega.shape, product)


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over a."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    mask = v = (1 << len(a)) - 1
    for x in b:
        if (m := where.get(x)) is not None:
            u = v & m
            v = ((v + u) | (v - u)) & mask
    return len(a) - v.bit_count()


def _spread(lo: np.ndarray, hi: np.ndarray, *columns: np.ndarray, listed: tuple[np.ndarray, ...] | None = None) -> tuple[np.ndarray, ...]:
    """Each row's columns repeated for every number from lo to hi - 1, which come first, or as what is listed there last."""
    n = np.maximum(0, hi - lo)
    number = np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)
    columns = tuple(np.repeat(c, n) for c in columns)
    return (number, *columns) if listed is None else (*columns, *(x[number] for x in listed))


class Items:
    """A block of benchmark items: words, answers, and unit vectors of their passages in the latent space."""

    def __init__(self, ids: list[int], columns: pa.Array):
        self.ids, self.words, self.answers = [], [], []
        self.slots, self.owner = [], []
        for item, text in zip(ids, columns.to_pylist(), strict=True):
            w = self._terms(text)
            if len(w) < 2:
                continue
            answer = text.rsplit("Answer:", 1)[1] if "Answer:" in text else next((s for s in reversed(text.replace("\n", ". ").split(". ")) if len(s.split()) > 1), text)
            n = len(self.ids)
            self.ids.append(item)
            self.words.append(w.tolist())
            self.answers.append(self._terms(answer).tolist())
            for a in range(0, max(1, len(w) - BLOCK), BLOCK):
                part = w[a : a + 2 * BLOCK]
                slot, _ = pairs(part, np.array([0, len(part)]))
                if len(slot):
                    self.slots.append(slot)
                    self.owner.append(n)
        self.vectors = np.zeros((0, 0), np.float32)
        self.bounds = np.searchsorted(self.owner, np.arange(len(self.ids) + 1))
        self._index()

    def _index(self) -> None:
        """Lists of items by word. A match holds `need` of an item's n words, so of its n - need + t rarest at least t."""
        freq = Counter(x for own in self.words for x in set(own))
        lists: dict[int, list[tuple[int, int]]] = {}
        self.least = np.zeros(len(self.words), np.int64)
        self.length = np.array([len(own) for own in self.words], np.int64)
        for i, own in enumerate(self.words):
            n = len(own)
            need = next(x for x in range(1, n + 1) if x / n >= LCS_FROM)
            self.least[i] = t = max(1, round(need * RARE_PART))
            for x, m in Counter(sorted(own, key=lambda x: (freq[x], x))[: n - need + t]).items():
                lists.setdefault(x, []).append((i, m))
        self.rare = np.array(sorted(lists), np.uint64)
        held = [lists[x] for x in sorted(lists)]
        self.rare_first = np.cumsum([0, *map(len, held)])
        self.rare_item = np.array([i for h in held for i, _ in h], np.int64)
        self.rare_times = np.array([m for h in held for _, m in h], np.int64)
        self.sieve = np.zeros(SIEVE, bool)
        self.sieve[self.rare & np.uint64(SIEVE - 1)] = True

    def holders(self, w: np.ndarray, first: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passage, item) where the passage and its surroundings hold enough of the item's rarest words: all that can match."""
        at = np.flatnonzero(self.sieve[w & np.uint64(SIEVE - 1)])
        word = np.searchsorted(self.rare, w[at])
        same = self.rare[np.minimum(word, len(self.rare) - 1)] == w[at]
        at, word = at[same], word[same]
        at, word, item, times = _spread(self.rare_first[word], self.rare_first[word + 1], at, word, listed=(self.rare_item, self.rare_times))
        doc = np.searchsorted(first, at, "right") - 1
        near = at - first[doc]
        lo = np.maximum(0, -((2 * BLOCK + self.length[item] - 1 - near) // BLOCK))
        hi = np.minimum(np.diff(base)[doc] - 1, (near + self.length[item]) // BLOCK)
        passage, item, word, times = _spread(base[doc] + lo, base[doc] + hi + 1, item, word, times)
        key, one = np.unique((passage * len(self.words) + item) * len(self.rare) + word, return_index=True)
        pair = key // len(self.rare)
        head = np.flatnonzero(np.diff(pair, prepend=-1))
        pair, count = pair[head], np.add.reduceat(times[one], head) if len(head) else head
        pair = pair[count >= self.least[pair % len(self.words)]]
        return pair // len(self.words), pair % len(self.words)

    @staticmethod
    def _terms(text: str) -> np.ndarray:
        data = np.frombuffer(text.encode(), np.uint8)
        return terms(data, np.array([0, len(data)]))[0]

    def project(self, space: Space) -> None:
        spans = [signed(space.idf, s) for s in self.slots]
        v = np.stack([w @ space.table[d] for d, w in spans]) if spans else np.zeros((0, space.table.shape[1]))
        self.vectors = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).astype(np.float32)


class Space:
    """The latent space of the documents' and some items' passages: idf by slot, and the directions as a table by dimension."""

    def __init__(self, sketch: Sketch, items: Items):
        self.idf = sketch.idf
        bench = np.zeros_like(sketch.gram)
        for s in items.slots:
            dim, weight = signed(self.idf, s)
            np.add.at(bench, dim, weight[:, None] * (weight.astype(np.float64) @ sketch.omega[dim]))
        scale = np.linalg.norm(sketch.gram) / max(np.linalg.norm(bench), 1e-12)
        # in the sketch, sums of random rows grow as the root of the weight
        vectors, values = nystroem(sketch.gram + BENCH_WEIGHT * (scale or 1.0) * bench, sketch.omega)
        keep = values[:RANK] >= CUT * max(values[0], 1e-12)
        self.table = vectors[:, :RANK][:, keep].astype(np.float32)


def nystroem(y: np.ndarray, omega: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors and singular values of X, largest first, from y = X'X omega."""
    shift = max(1e-300, np.finfo(float).eps * np.linalg.norm(y))
    while True:
        moved = y + shift * omega
        core = omega.T @ moved
        try:
            lower = np.linalg.cholesky((core + core.T) / 2)
            break
        except np.linalg.LinAlgError:  # not positive within rounding
            shift *= 10
    u, s, _ = np.linalg.svd(np.linalg.solve(lower, moved.T).T, full_matrices=False)
    return u, np.sqrt(np.maximum(s**2 - shift, 0))


MATCHES = "doc_id long, item_id long, start_word long, cosine double, lcs_ratio double, answer_ratio double, latent boolean"


def matches(space: Space, items: Items, column: pa.Array) -> Iterator[tuple[int, int, int, float, float, float, bool]]:
    """(row, item, first word of the passage, cosine, LCS and answer ratios, whether the latent search had the text as well): for each text and item the best passage."""
    for i, _, data, offsets in chunks(column):
        w, first = terms(data, offsets)
        if len(w) < 2 or not len(items.vectors):
            continue
        base = block_base(first)
        slot, block = pairs(w, first)
        n = int(base[-1])
        dim, weight = signed(space.idf, slot)
        v = passage_sums(_rowsum(space.table, dim, weight, block, n), base)
        norm = np.sqrt(np.maximum(passage_sums(np.bincount(block, weight * weight, n), base), 1e-12))
        inner = np.linalg.norm(v, axis=1)
        near = np.flatnonzero(inner >= ENERGY_FROM * norm)
        cosine = (v[near] / np.maximum(inner[near, None], 1e-12)) @ items.vectors.T
        a, b = np.nonzero(cosine >= COSINE_FROM)
        latent = near[a] * len(items.words) + np.array(items.owner)[b]
        passage, item = items.holders(w, first, base)
        best: dict[tuple[int, int], tuple] = {}
        for pair in np.union1d(latent, passage * len(items.words) + item).tolist():
            p, item = divmod(pair, len(items.words))
            row = int(np.searchsorted(base, p, "right")) - 1
            start = int(first[row]) + (p - int(base[row])) * BLOCK
            own, answer = items.words[item], items.answers[item]
            lo, hi = max(int(first[row]), start - len(own)), min(int(first[row + 1]), start + 2 * BLOCK + len(own))
            held = best.get((row, item))
            if held and held[2] >= 0.999:
                continue
            around = w[lo:hi].tolist()
            there = set(around)
            if sum(x in there for x in own) / len(own) < LCS_FROM:
                continue
            ratio = lcs(own, around) / len(own)
            if ratio < LCS_FROM or held and held[2] >= ratio:
                continue
            said = lcs(answer, around) / len(answer) if answer else 1.0
            if said >= ANSWER_FROM:
                close = float((items.vectors[items.bounds[item] : items.bounds[item + 1]] @ v[p]).max() / max(inner[p], 1e-12))
                best[row, item] = (start - int(first[row]), close, ratio, said)
        # which of the matches the latent search has proposed, in any passage
        rows = np.searchsorted(base, near[a], "right") - 1 if best else near[:0]
        proposed = np.isin([r * len(items.words) + k for r, k in sorted(best)], rows * len(items.words) + np.array(items.owner)[b] if best else rows)
        for ((row, item), found), latent in zip(sorted(best.items()), proposed.tolist(), strict=True):
            yield i + row, items.ids[item], *found, latent


def blocks_of_items(bench: DataFrame) -> Iterator[tuple[Items, bool]]:
    """The query set in blocks of QUERY_ITEMS items by id, so that one block bounds what is sent to tasks; and whether more may follow."""
    bench = bench.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct()
    key, low = F.struct("item_id", "text"), None
    while True:
        rows = (bench if low is None else bench.where(key > low)).orderBy(key).limit(QUERY_ITEMS).collect()
        more = len(rows) == QUERY_ITEMS
        if rows:
            yield Items([r["item_id"] for r in rows], pa.array([r["text"] for r in rows], pa.string())), more
        if not more:
            return
        low = F.struct(F.lit(rows[-1]["item_id"]).cast("long").alias("item_id"), F.lit(rows[-1]["text"]).alias("text"))


def spaces(docs: DataFrame, bench: DataFrame) -> Iterator[tuple[tuple[Space, Items], bool]]:
    """The space of each block of items, with its items; the documents are summed up once."""
    sketch = None
    for items, more in blocks_of_items(bench):
        sketch = sketch or Sketch(docs)
        space = Space(sketch, items)
        items.project(space)
        yield (space, items), more


def find_matches(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """All matches of docs(doc_id, text) with bench(item_id, text)."""
    spark = docs.sparkSession
    schema = arrow_schema(MATCHES, spark)
    out = spark.createDataFrame([], MATCHES)
    for pair, _ in spaces(docs, bench):
        sent = spark.sparkContext.broadcast(pair)

        def search(batches, sent=sent):
            for batch in batches:
                ids = batch.column(0).to_pylist()
                found = [(ids[r], *rest) for r, *rest in matches(*sent.value, texts(batch.column(1)))]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True) if found else [[]] * 7, schema, strict=True)], schema=schema)

        out = out.unionByName(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(search), MATCHES))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with a match go."""
    at = docs.columns.index("text")
    for pair, more in spaces(docs, read(spark, sf_dir, "benchmark")):
        sent = spark.sparkContext.broadcast(pair)

        def clean(batches, sent=sent):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for row, *_ in matches(*sent.value, texts(batch.column(at))):
                    keep[row] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(tidy(clean), docs.schema)
        docs = materialize(docs, "clean") if more else docs
    return docs
