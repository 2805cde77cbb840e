"""Suffix dedup, Jaccard join and line dedup against brute force."""

import hashlib
import random
import re
import string
from collections import Counter

import numpy as np
import pytest
from corpus import documents, frame

from tallyloom.llm import jaccard_join, line_dedup, suffix_dedup

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def write(spark, tmp_path, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def brute_spans(rows, length=100):
    """Rows that share a doc_id, or have none, are documents of their own, here in the order of ``rows``."""
    place, out = {}, []
    last = 1 << 63
    key = lambda n, doc, i: (last if doc is None else doc, n, i)
    for n, (doc, text, *_) in enumerate(rows):
        b = (text or "").encode()
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            place[w] = min(place.get(w, (last + 1, 0, 0)), key(n, doc, i))
    for n, (doc, text, *_) in enumerate(rows):
        b = (text or "").encode()
        mark = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if place[b[i : i + length]] < key(n, doc, i):
                mark[i : i + length] = b"\1" * length
        kept = bytes(c for c, m in zip(b, mark) if not m)
        out.append((doc, len(b), sum(mark), len([x for x in bytes(mark).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("many,hot", [(256, 4096), (1, 4096), (256, 2), (3, 4)])
def test_suffix_dedup(spark, tmp_path, monkeypatch, many, hot):
    monkeypatch.setattr(suffix_dedup, "MANY", many)
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rows = documents() + [(60 + i, "x" * 150 + str(i), "s") for i in range(5)]
    d = write(spark, tmp_path, documents=frame(spark, rows).repartition(5))
    got = [tuple(r) for r in suffix_dedup.query(spark, d).collect()]
    assert sorted(got, key=repr) == brute_spans(rows)


def odd_ids():
    """Different texts under one doc_id and under none, that share passages with others or with nothing."""
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice(string.ascii_letters) for _ in range(n))
    shared, twin = text(150), text(400)
    return [(1, shared + text(60)), (None, shared + text(70)), (None, text(300)), (7, shared + text(80)), (7, text(280)), (7, twin), (7, twin), (None, twin[:200]), (None, text(90)), (3, None), (3, "")], shared, twin


@pytest.mark.parametrize("from_table", [True, False])
def test_suffix_dedup_of_repeated_and_null_ids(spark, tmp_path, from_table):
    rows, shared, twin = odd_ids()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    if from_table:
        docs.repartition(3).write.parquet(f"{tmp_path}/d")
        docs = spark.read.parquet(f"{tmp_path}/d")
    got = sorted((tuple(r)[:4] for r in suffix_dedup.report(docs).collect()), key=repr)
    # of equal twins under one id, either may be the one that stays
    assert got == sorted((r[:4] for r in brute_spans(rows)), key=repr)


def test_suffix_order_is_that_of_sorted_strings():
    rng = np.random.default_rng(2)
    text = np.concatenate([rng.integers(97, 99, 600), np.full(300, 97), rng.integers(97, 99, 600)]).astype(np.uint8)
    text[900:1300] = text[50:450]
    starts = np.arange(len(text) - 99)
    order, head = suffix_dedup.suffix_order(text, starts)
    strings = [bytes(text[i : i + 100]) for i in starts]
    assert [strings[i] for i in order] == sorted(strings)
    assert [bool(h) for h in head] == [k == 0 or strings[order[k]] != strings[order[k - 1]] for k in range(len(order))]


def test_triggers_are_those_of_the_parse():
    data = np.frombuffer(documents()[29][1].encode() + b"ab" * 300, np.uint8)
    t, _, _, lo, hi = suffix_dedup.phrases(data, np.array([0, len(data)]))
    size = hi - lo + suffix_dedup.LENGTH
    content = np.concatenate([data[a : a + n] for a, n in zip(lo, size)])
    assert (suffix_dedup.triggers(content, np.cumsum(size) - size, hi - lo + 1) == t).all() and len(t) > 500


def test_suffix_dedup_slices_of_a_long_text(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE", 512)
    import pyarrow as pa

    text = pa.array([documents()[29][1]])
    whole = [x for part in suffix_dedup._parsed(text) for x in zip(*(np.asarray(c).tolist() for c in part[3:]))]
    starts = sorted(s for lo, hi in whole for s in range(lo, hi + 1))
    assert starts == list(range(len(text[0].as_py().encode()) - 99))


def word_set(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_parts(sets):
    """Indices of the sets by component of their links."""
    root = list(range(len(sets)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    parts = {}
    for i in range(len(sets)):
        parts.setdefault(top(i), []).append(i)
    return list(parts.values())


def brute_components(rows):
    sets = [word_set(text) for _, text, *_ in rows]
    out = []
    for part in brute_parts(sets):
        least = min((rows[i][0] for i in part if rows[i][0] is not None), default=None)
        out += [(rows[i][0], len(sets[i]), least) for i in part]
    return sorted(out, key=repr)


@pytest.mark.parametrize("tokens,edges", [(2_000_000, 1 << 20), (150, 0)])
def test_jaccard_components(spark, monkeypatch, tokens, edges):
    monkeypatch.setattr(jaccard_join, "BLOCK_TOKENS", tokens)  # small blocks: pivots and parts
    monkeypatch.setattr(jaccard_join, "LOCAL_EDGES", edges)  # none: alternating stars
    rows = documents()
    base = rows[7][1].split()
    rows += [(100 + i, " ".join([*base[: i * 2], f"new{i}", *base[i * 2 + 1 :]]), "s") for i in range(14)]
    got = [tuple(r) for r in jaccard_join.jaccard_components(frame(spark, rows).repartition(3)).collect()]
    assert sorted(got, key=repr) == brute_components(rows)


def test_a_block_is_cut_where_prefixes_share_a_shingle_by_chance(spark, monkeypatch):
    """Pairs of copies in a chain, each sharing some shingles with the next, are one block at first."""
    monkeypatch.setattr(jaccard_join, "BLOCK_TOKENS", 400)
    joins = []
    monkeypatch.setattr(jaccard_join, "_join_task", lambda tasks, f=jaccard_join._join_task: joins.append(1) or f(tasks))
    rows = []
    for i in range(16):
        text = [*(f"k{i}.{k}" for k in range(16)), *(f"c{i}.{k}" for k in range(40)), *(f"k{i + 1}.{k}" for k in range(16))]
        rows += [(10 * i, " ".join(text), "s"), (10 * i + 1, " ".join([*text[:-1], "other"]), "s")]
    got = [tuple(r) for r in jaccard_join.jaccard_components(frame(spark, rows).repartition(3)).collect()]
    assert sorted(got, key=repr) == brute_components(rows)
    assert len(joins) == 1  # no block is left that takes pivots and parts


def test_rows_of_the_join_follow_the_documents(spark, monkeypatch):
    """Stage 3 of the pipeline on chains of one block: a set goes to a bounded number of tasks, however long the chain."""
    import corpus_pipeline

    monkeypatch.setattr(jaccard_join, "BLOCK_TOKENS", 400)
    dealt = []
    monkeypatch.setattr(jaccard_join, "_join_task", lambda tasks, f=jaccard_join._join_task: dealt.append(tasks.count()) or f(tasks))
    stage = dict(corpus_pipeline.STAGES)["jaccard_join"]

    def run(length):
        rows = []
        for i in range(length):
            text = [*(f"k{i}.{k}" for k in range(16)), *(f"c{i}.{k}" for k in range(40)), *(f"k{i + 1}.{k}" for k in range(16))]
            rows += [(10 * i, " ".join(text), "s"), (10 * i + 1, " ".join([*text[:-1], "other"]), "s")]
        dealt.clear()
        got = sorted(r["doc_id"] for r in stage(spark, frame(spark, rows).repartition(3), "").collect())
        assert got == sorted({r[2] for r in brute_components(rows)})
        return sum(dealt) / len(rows)

    assert run(32) <= 1.5 * run(8)


def test_one_more_bucket_does_not_halve_the_bitmaps(spark, monkeypatch):
    """Texts that share two fifths of their shingles with others, and link with none, drop out just below a power of two of bits, too."""
    monkeypatch.setattr(jaccard_join, "BITMAP_BYTES", 4 * 2047 // 7 + 1)  # for the four buckets of a small table
    kept = []
    monkeypatch.setattr(jaccard_join, "_sets", lambda *a, f=jaccard_join._sets: kept.append(f(*a).count()) or f(*a))
    passages = [" ".join(f"p{i}.{k}" for k in range(42)) for i in range(95)]
    rows = [(i, passages[i % 95] + " " + " ".join(f"o{i}.{k}" for k in range(58))) for i in range(190)]
    got = [tuple(r) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=repr) == brute_components(rows)
    assert kept[0] < len(rows) / 2


@pytest.mark.parametrize("light", [1, 3, 64])
def test_cut_blocks_lose_no_link(spark, monkeypatch, light):
    monkeypatch.setattr(jaccard_join, "BLOCK_TOKENS", 40)
    monkeypatch.setattr(jaccard_join, "LIGHT", light)
    monkeypatch.setattr(jaccard_join, "PAIRS_AT_ONCE", 50)
    rng = np.random.default_rng(light)
    rows = []
    for i in range(160):  # few words, so that shingles are shared by chance as well
        base = np.random.default_rng(i % 23).integers(0, 6, 30 + i % 9)
        rows.append((i, " ".join(f"w{x}" for x in np.where(rng.random(len(base)) < 0.02, rng.integers(0, 6, len(base)), base)), "s"))
    got = [tuple(r) for r in jaccard_join.jaccard_components(frame(spark, rows).repartition(3)).collect()]
    want = brute_components(rows)
    assert sorted(got, key=repr) == want and 1 < len({r[2] for r in want}) < 160


def test_jaccard_without_rows(spark):
    assert jaccard_join.jaccard_components(frame(spark, [])).collect() == []


def test_trie_links_equal_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(20):
        base = rng.choice(10_000, 60, replace=False)
        sets = [np.unique(np.where(rng.random(60) < 0.12, rng.integers(0, 10_000, 60), base)).astype(np.uint64) for _ in range(12)]
        tiers = [(s % np.uint64(3)).astype(np.int8) for s in sets]
        order = [np.lexsort((s, t)) for s, t in zip(sets, tiers)]
        found = jaccard_join.trie_links([s[o] for s, o in zip(sets, order)], [t[o] for t, o in zip(tiers, order)], list(range(12)))
        near = [(i, j) for i in range(12) for j in range(i) if 175 * len(np.intersect1d(sets[i], sets[j])) >= 75 * (len(sets[i]) + len(sets[j]))]

        def parts(pairs):
            root = list(range(12))
            for a, b in pairs:
                x, y = root[a], root[b]
                root = [y if r == x else r for r in root]
            return {frozenset(i for i in range(12) if root[i] == r) for r in root}

        assert parts(found) == parts(near)


def test_jaccard_stage_keeps_one_of_each(spark):
    docs = frame(spark, documents(), extra=False)
    kept = jaccard_join.stage(spark, docs, "")
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    least = {c for _, n, c in brute_components(documents()) if n}
    assert {i for i in ids if i is not None} - least == {22, 23, 24} and len(ids) == len(set(ids))


def test_jaccard_stage_of_repeated_and_null_ids(spark):
    t, u, v = (" ".join(f"{c}{i}" for i in range(40)) for c in "tuv")
    rows = [(5, t, 1), (30, t, 2), (30, u, 3), (None, t, 4), (None, t, 5), (9, v, 6), (None, u, 7), (None, None, 8), (30, "", 9), (None, v + " more", 10)]
    for columns in ("doc_id long, text string, row long", "doc_id long, text string, part long"):
        kept = jaccard_join.stage(spark, spark.createDataFrame(rows, columns).repartition(3), "")
        assert sorted(r[2] for r in kept.collect()) == [1, 3, 6, 8, 9]


def brute_lines(rows, min_docs=10):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    lines = [(r[1] or "").split("\n") for r in rows]
    count = Counter(k for ls in lines for k in {key(x) for x in ls} if k)
    out = []
    for r, ls in zip(rows, lines):
        kept = [x for x in ls if count[key(x)] < min_docs]
        out.append((r[0], len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def lined():
    """Documents with more common lines than one, more and less frequent."""
    rows = documents()
    return rows + [(80 + i, "\n".join([f"own {i}", *(f"Shared {k}" for k in range(6) if i % (k + 1) < 2)]), "s1") for i in range(40)]


@pytest.mark.parametrize("resident,fingers", [(1 << 20, 32), (3, 32), (0, 32), (3, 1)])
def test_line_dedup(spark, tmp_path, monkeypatch, resident, fingers):
    """All filters sent, or some, or none; with chance hits in plenty as well."""
    defaults = list(line_dedup.drop_lines.__defaults__)
    defaults[4] = resident
    monkeypatch.setattr(line_dedup.drop_lines, "__defaults__", tuple(defaults))
    if fingers == 1:
        monkeypatch.setattr(line_dedup.CuckooFilter, "fingerprint", staticmethod(lambda k2: np.ones(len(k2), np.uint32)))
    d = write(spark, tmp_path, documents=frame(spark, lined()).repartition(3))
    got = [tuple(r) for r in line_dedup.query(spark, d).collect()]
    assert sorted(got, key=repr) == brute_lines(lined())


@pytest.mark.parametrize("resident", [1 << 20, 0])
def test_line_stage_keeps_columns_of_any_name(spark, monkeypatch, resident):
    defaults = list(line_dedup.drop_lines.__defaults__)
    defaults[4] = resident
    monkeypatch.setattr(line_dedup.drop_lines, "__defaults__", tuple(defaults))
    docs = spark.createDataFrame(lined(), "doc_id long, text string, source string")
    names = ("n_lines", "n_dropped", "row", "row_", "drops", "th", "k1", "docs", "bucket")
    for n in names:
        docs = docs.selectExpr("*", f"concat('{n}', source) AS {n}")
    kept = line_dedup.stage(spark, docs, "")
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert all(r["source"] is None or r[n] == n + r["source"] for r in rows for n in names)
    assert Counter(hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in rows) == Counter(h for *_, h in brute_lines(lined()))


def test_chance_hits_are_exceptions(spark, monkeypatch):
    monkeypatch.setattr(line_dedup.CuckooFilter, "fingerprint", staticmethod(lambda k2: np.ones(len(k2), np.uint32)))
    docs = frame(spark, documents())
    got = line_dedup.drop_lines(docs, shards=1).agg({"n_dropped": "sum"}).first()[0]
    assert got == sum(r[2] for r in brute_lines(documents()))


def test_line_index_is_reversible(spark):
    docs = frame(spark, documents())
    old, new = docs.where("doc_id < 45 or doc_id is null"), docs.where("doc_id >= 45")
    index = line_dedup.LineIndex.of(old)
    both = index.insert(new)
    pairs = lambda x: sorted(map(tuple, x.counts.collect()))
    assert pairs(both) == pairs(line_dedup.LineIndex.of(docs)) and pairs(both.delete(new)) == pairs(index)
    built = lambda x: {r["shard"]: bytes(r["filter"]) for r in line_dedup.build_filters(x.counts, shards=4).collect()}
    moved = {r["shard"]: bytes(r["filter"]) for r in both.update_filters(built(index), index, shards=4).collect()}
    common = both.counts.where("docs >= 10").toPandas()
    assert len(common) == 1 and line_dedup.Screen({**built(index), **moved}, [], 4).hits(common["k1"].to_numpy(), common["k2"].to_numpy()).all()


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    k = rng.integers(-(2**62), 2**62, (2, 4000))
    f = line_dedup.CuckooFilter.build(k[0], k[1])
    assert f.contains(k[0], k[1]).all()
    f.delete(k[0, :2000].copy(), k[1, :2000].copy())
    assert f.contains(k[0, 2000:].copy(), k[1, 2000:].copy()).all() and f.contains(k[0, :2000].copy(), k[1, :2000].copy()).mean() < 0.01


def test_empty_tables(spark, tmp_path):
    d = write(spark, tmp_path, documents=frame(spark, []))
    assert suffix_dedup.query(spark, d).collect() == [] and line_dedup.query(spark, d).collect() == []
