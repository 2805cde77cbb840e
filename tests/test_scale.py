"""Large groups and large choices: what is done in blocks, ranges or rounds equals what one pass over all rows gives."""

import hashlib
import itertools
import math
import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import inside, pairs, quality, resample, sampling, scan, shared
from tallyloom.plans import catalog


@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Small tables in as many ranges as large ones."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def digest(seed, *keys):
    return hashlib.sha256(":".join([str(seed), *map(str, keys)]).encode()).hexdigest()


def greedy(rows, seed, caps, total=None):
    counts, kept = Counter(), []
    for key, *slots in sorted(rows, key=lambda r: (digest(seed, r[0]), r[0])):
        if (total is None or len(kept) < total) and all(counts[c, s] < n for (c, n), s in zip(caps.items(), slots, strict=True)):
            counts.update(zip(caps, slots, strict=True))
            kept.append(key)
    return sorted(kept)


@pytest.mark.parametrize("seed", range(4))
def test_greedy_caps_are_those_of_one_pass(spark, seed):
    rng = random.Random(seed)
    hot = lambda n: None if rng.random() < 0.1 else 0 if rng.random() < 0.4 else rng.randint(1, n)
    rows = [(i, hot(12), hot(30), f"k{rng.randint(0, 5)}") for i in range(400)]
    caps = {"page": 3, "company": 5, "kind": 20}
    df = spark.createDataFrame(rows, "pair_id long, page long, company long, kind string").repartition(5)
    for total in (None, 1, 17, 1000):
        got = sorted(r["pair_id"] for r in sampling.greedy_caps(df, seed, caps, total=total).collect())
        assert got == greedy(rows, seed, caps, total)
    assert sampling.greedy_caps(df.where("false"), seed, caps).count() == 0


def test_a_chain_that_takes_as_many_rounds_as_it_has_links(spark):
    """Every row shares one group with the row before it in order and one with the row after it."""
    order = sorted(range(24), key=lambda k: digest(1, k))
    rows = [(k, i // 2, (i + 1) // 2) for i, k in enumerate(order)]
    df = spark.createDataFrame(rows, "pair_id long, page long, company long")
    assert sorted(r[0] for r in sampling.greedy_caps(df, 1, {"page": 1, "company": 1}).select("pair_id").collect()) == greedy(rows, 1, {"page": 1, "company": 1})


@pytest.mark.parametrize("few", [1, 7, 4096])
def test_the_first_rows_by_digest(spark, monkeypatch, few):
    monkeypatch.setattr(sampling, "FEW", few)
    monkeypatch.setattr(sampling, "PREFIX_DIGITS", 1)
    keys = list(range(300))
    df = spark.createDataFrame([(k,) for k in keys], "k long").withColumn("h", sampling.digest(2, F.col("k")))
    order = sorted(keys, key=lambda k: digest(2, k))
    for n in (0, 1, 2, 150, 299, 300, 301):
        assert sorted(r["k"] for r in df.where(sampling.among_first(df, n, "h", "k")).collect()) == sorted(order[:n])
    out = sampling.dev_split(df.select("k"), 2, 0.15, "k")
    assert {r["k"] for r in out.where("is_dev").collect()} == set(order[:45]) and out.columns == ["k", "is_dev"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "TakeOrdered" not in plan


def islands(rows, gap):
    out = {}
    for _, group in itertools.groupby(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2] is None, r[2] or 0, r[1])), key=lambda r: r[0]):
        n, before = 0, None
        for user, i, x in group:
            if x is not None and before is not None and x - before > gap:
                n += 1
            before = x
            out[i] = -1 if x is None else n
    return out


@pytest.mark.parametrize("hot", [5, 60, 10_000])
def test_islands_of_a_user_with_half_of_all_rows(spark, hot):
    rng = random.Random(hot)
    rows = [(1 if rng.random() < 0.5 else None if rng.random() < 0.2 else rng.randint(2, 9), i, None if rng.random() < 0.1 else rng.randint(0, 900) / 2) for i in range(600)]
    df = spark.createDataFrame(rows, "user long, i long, x double").repartition(3)
    got = {r["i"]: r["cluster"] for r in quality.column_clusters(df, ["user"], "x", "i", 3.0, hot).collect()}
    assert got == islands(rows, 3.0)


@pytest.mark.parametrize("hot", [3, 40, 10_000])
def test_gap_candidates_of_large_groups(spark, hot):
    rng = random.Random(hot)
    rows = [(rng.choice([1, 1, 1, 2, 3, 4, 5, None]), i, None if rng.random() < 0.1 else float(rng.randint(0, 40) + 500 * (rng.random() < 0.3))) for i in range(160)]
    rows += [(70 + k, 1000 + 10 * k + i, float(i * i + 9 * (i > 2))) for k in range(4) for i in range(k + 2)]
    want = {}
    for user in {r[0] for r in rows}:
        xs = sorted((x, i) for u, i, x in rows if u == user and x is not None)
        gaps = [b[0] - a[0] for a, b in itertools.pairwise(xs)]
        if len(xs) >= 3:
            at = gaps.index(max(gaps))
            median = statistics.median(gaps[:at] + gaps[at + 1 :])
            if median > 0 and gaps[at] >= 2.5 * median:
                want[user] = (len(xs), gaps[at], at + 1, median)
    df = spark.createDataFrame(rows, "user long, i long, x double")
    got = {r["user"]: (r["rows"], r["largest"], r["after_row"], r["median_other"]) for r in quality.gap_candidates(df, ["user"], "x", "i", hot).collect()}
    assert got == want and len(want) > 1


def test_ranges_cut_through_a_group(spark):
    df = spark.range(1000).selectExpr("id % 2 * (id % 7) AS g", "id", "1.0 * id AS x")
    ranged = scan.in_ranges(df, ["g"], [F.col("x")])
    assert ranged.where("g = 0").select("__part").distinct().count() > 1
    out = scan.with_running(scan.with_previous(ranged, ["g"], "id", "before"), ["g"], F.lit(1), "k")
    by = {}
    for r in out.orderBy("g", "x").collect():
        before = by.setdefault(r["g"], [])
        assert r["before"] == (before[-1] if before else None) and r["k"] == len(before) + 1
        before.append(r["id"])


@pytest.mark.parametrize("block", [4, 9, 10_000])
def test_pairs_of_a_table_with_half_of_all_rows(spark, block):
    rng = random.Random(block)
    rows = [(0 if rng.random() < 0.5 else None if rng.random() < 0.1 else rng.randint(1, 6), i, rng.randint(0, 5)) for i in range(90)]
    df = spark.createDataFrame(rows, "t long, q long, v long")
    got = pairs._self_join(df, ["t"], ["t", "q", "v"], F.col("q_a") < F.col("q_b"), block)
    want = sorted((a[0], *x, *y) for a in rows for b in rows for x, y in [(a[1:], b[1:])] if a[0] is not None and a[0] == b[0] and a[1] < b[1])
    assert sorted((r["t"], r["q_a"], r["v_a"], r["q_b"], r["v_b"]) for r in got.collect()) == want
    assert got.columns == ["t", "q_a", "v_a", "q_b", "v_b"]


def test_similar_labels_by_rare_words(spark):
    rng = random.Random(5)
    rare = [f"word{i}x" for i in range(60)]
    labels = sorted({" ".join(rng.sample(["net", "total", "group"], rng.randint(0, 3)) + rng.sample(rare, rng.randint(1, 5))) for _ in range(250)} | {"adjusted ebitda margin", "ebitda margin", "of the", "net", "adjusted net"})
    words = {x: {w for w in x.split() if len(w) > 1 and w not in {"of", "the"}} for x in labels}
    df = spark.createDataFrame([(x,) for x in labels], "metric string")
    got = {(r["metric_a"], r["metric_b"]): (round(r["jaccard"], 9), r["basis"]) for r in pairs.related_metrics(df).collect()}
    alike = {(a, b): len(words[a] & words[b]) / len(words[a] | words[b]) for a, b in itertools.combinations(labels, 2) if words[a] & words[b] and 2 * len(words[a] & words[b]) >= len(words[a] | words[b])}
    assert {k: v for k, (v, basis) in got.items() if v >= 0.5} == {k: round(v, 9) for k, v in alike.items()}
    assert got[("adjusted ebitda margin", "ebitda margin")][1] and got[("adjusted net", "net")][1]
    sharing = sum(1 for a, b in itertools.combinations(labels, 2) for _ in words[a] & words[b])
    assert pairs.similar_candidates(df).count() < sharing / 4


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 97, 100, 101, 1000])
def test_a_computed_permutation_is_one(spark, n):
    keys = F.array(*(F.lit(k).cast("long") for k in (5, 77, 123456, 99, 31, 8)))
    places = [r["to"] for r in resample.permuted(spark.range(n).withColumn("keys", keys), "id", n, "keys", "to").orderBy("id").collect()]
    assert sorted(places) == list(range(n))
    if n >= 97:
        assert places != list(range(n)) and sum(p == i for i, p in enumerate(places)) < n / 4


def brute_bootstrap(a, b, replicates, seed):
    both = sorted(set(a) & set(b))
    out = []
    for r in range(replicates):
        picks = [both[int(digest(seed, r, s)[:15], 16) % len(both)] for s in range(len(both))]
        (na, da), (nb, db) = ([sum(x) for x in zip(*(side[c] for c in picks), strict=True)] for side in (a, b))
        if da and db:
            out.append(nb / db - na / da)
    out.sort()
    at = lambda p: out[min(int(p * len(out)), len(out) - 1)]
    return len(out), at(0.025), at(0.975)


@pytest.mark.parametrize("room", [0, 48 << 20])
def test_bootstrap_by_vectors_and_by_rows(spark, monkeypatch, room):
    monkeypatch.setattr(resample, "BROADCAST_BYTES", room)
    monkeypatch.setattr(shared, "BROADCAST_BYTES", room)
    rng = random.Random(1)
    items = [(side, f"c{rng.randint(0, 8)}" if rng.random() < 0.9 else None, rng.randint(0, 1), rng.choice([0, 1, 1])) for side in "ab" for _ in range(80)]
    df = spark.createDataFrame(items, "side string, c string, num long, den long")
    sums = {s: {c: [sum(r[i] for r in items if r[0] == s and r[1] == c) for i in (2, 3)] for c in {r[1] for r in items if r[0] == s and r[1]}} for s in "ab"}
    a, b = (df.where(F.col("side") == s) for s in "ab")
    r = resample.bootstrap_delta(a, b, F.col("num"), F.col("den"), "c", 60, 4).first()
    n, low, high = brute_bootstrap(sums["a"], sums["b"], 60, 4)
    assert (r["replicates"], round(r["ci_low"], 9), round(r["ci_high"], 9)) == (n, round(low, 9), round(high, 9))
    assert resample.bootstrap_delta(a.where("false"), b, F.col("num"), F.col("den"), "c", 20, 4).collect() == []

    tables = [(f"c{rng.randint(0, 6)}", f"t{rng.randint(0, 9)}" if rng.random() < 0.9 else None, rng.randint(0, 1), 1) for _ in range(90)]
    clusters = sorted({t[0] for t in tables})
    means = []
    for rep in range(40):
        drawn = {clusters[int(digest(4, rep, s)[:15], 16) % len(clusters)] for s in range(len(clusters))}
        per = {}
        for c, t, num, den in tables:
            if c in drawn:
                per.setdefault(t, [0, 0])[0] += num
                per[t][1] += den
        means.append(statistics.fmean(x / y for x, y in per.values()))
    means.sort()
    got = resample.macro_bootstrap(spark.createDataFrame(tables, "c string, table_id string, num long, den long"), "c", 40, 4).first()
    assert (got["replicates"], round(got["ci_low"], 9), round(got["ci_high"], 9)) == (40, round(means[1], 9), round(means[39], 9))
    items = [(i, f"t{rng.randint(0, 5)}", rng.randint(0, 9)) for i in range(70)]
    values = sorted({(f"t{rng.randint(0, 5)}", rng.randint(0, 9)) for _ in range(30)})
    one = resample.permutation_null(spark.createDataFrame(items, "item long, table_id string, predicted long"), spark.createDataFrame(values, "table_id string, value long"), 25, 3).first()
    assert one["observed"] == sum((t, p) in values for _, t, p in items) / 70 and 0 < one["p"] <= 1 and one["null_p05"] <= one["null_mean"] <= one["null_p95"]


def test_tokens_near_shuffles_no_pairs(spark, monkeypatch):
    """Blocks of any size give the lists of brute force, and what is near is not shuffled."""
    monkeypatch.setattr(quality, "ROWS", 7)
    monkeypatch.setattr(quality, "AT_ONCE", 50)
    rng = random.Random(5)
    at = lambda: sorted(rng.sample(range(100), 2))
    fields = [(i, i % 3 if i % 10 else None, *(x for p in zip(at(), at()) for x in p), "v") for i in range(60)]
    tokens = [(i % 4 if i % 9 else None, *(x for p in zip(at(), at()) for x in p), i, None if i % 8 == 0 else f"t{i}", i % 5) for i in range(80)]
    f = spark.createDataFrame(fields, "field_id long, page long, top int, left int, bottom int, right int, value string")
    t = spark.createDataFrame(tokens, "page long, top int, left int, bottom int, right int, ordinal long, text string, confidence int")
    out = quality.tokens_near(f, t, 3)
    want = {i: sorted((l2, o, x, c) for q, t2, l2, b2, r2, o, x, c in tokens if q is not None and q == p and t1 - 3 <= (t2 + b2) / 2 <= b1 + 3 and l1 - 3 <= (l2 + r2) / 2 <= r1 + 3) for i, p, t1, l1, b1, r1, _ in fields}
    assert {r["field_id"]: [tuple(n) for n in r["near"]] for r in out.collect()} == want and any(want.values())
    assert "collect_list" not in out._jdf.queryExecution().executedPlan().toString()


FIELDS = "field_id long, page long, top double, left double, bottom double, right double, value string, kind string"
TOKENS = "page long, top double, left double, bottom double, right double, ordinal long, text string, confidence int"


@pytest.mark.parametrize("seed", range(2))
def test_ocr_outcomes_are_those_of_the_lists(spark, monkeypatch, seed):
    """Counts and marks of parts give what the whole lists give, whatever the texts; equal fields and odd boxes stay."""
    for module, name, n in ((quality, "FIELDS", 40), (quality, "TOKENS", 16), (inside, "AT_ONCE", 7)):
        monkeypatch.setattr(module, name, n)
    rng = random.Random(seed)
    texts = [None, "", " ", "\t", "12", "1,", "1, ", "234", "1,234", "12.5", "-3", "x7y", "net", "Net", "profit", "net profit", "fit for", "of the year", "ye", "9" * 400, "0", "1200", "12.1", "0.0012", "\u00a0net\u2003debt", "STRASSE", "a, 5", "12 1200"]
    values = [None, "", "12", "12.3", "3", "-12", "1234", "$1,200", "0", "NaN", "net", "NET profit", "t pro", "profit net", "net  debt", "of", "strasse", "year of the", "net net", "inf", "12000000", "word " * 70]
    side = lambda: [rng.choice(odd) if rng.random() < 0.02 else rng.randint(0, 40) / 2 for _ in range(2)]
    odd = [None, math.nan]
    wide = lambda: sorted(x for x in side() if x is not None) if rng.random() < 0.9 else side()
    box = lambda: (lambda v, h: (v[0], h[0], v[-1], h[-1]))(wide() or [None], wide() or [None])
    page = lambda: None if rng.random() < 0.05 else rng.choice([1, 1, 1, 2, 3])
    fields = [(i, page(), *box(), rng.choice(values), rng.choice(["monetary", "numerical", "text", "text", None])) for i in range(260)]
    fields += [*fields[:20], (900, 7, 0.0, 0.0, 9.0, 9.0, "12", "text")]
    odd.remove(math.nan)  # a list of tokens takes no such place
    kinds = rng.sample(texts, 9), texts  # a page of few kinds of text, others of all
    tokens = [(p := page(), *box(), i, rng.choice(kinds[p != 1]), rng.choice([None, 10, 70, 95])) for i in range(60)]
    f, t = spark.createDataFrame(fields, FIELDS), spark.createDataFrame(tokens, TOKENS)
    near = quality.tokens_near(f, t, 1)
    want = near.select("field_id", "value", quality.ocr_outcome(F.col("value"), F.col("kind"), F.col("near")).alias("outcome"))
    out = quality.ocr_outcomes(f, t, 1)
    assert out.columns == [*f.columns, "outcome"]
    assert Counter(map(tuple, out.select("field_id", "value", "outcome").collect())) == Counter(map(tuple, want.collect()))


def test_numbers_and_words_among_many(spark):
    """Outcomes that one token decides, on a page whose tokens fill many levels."""
    rng = random.Random(1)
    at = lambda n: sorted(rng.randint(0, 999) for _ in range(n))
    tokens = [(1, float(y), float(x), float(y), float(x), i, rng.choice([str(rng.randint(1, 400)), f"{rng.randint(1, 9)}.{rng.randint(0, 99)}", rng.choice("abcdef") * rng.randint(1, 4)]), rng.randint(0, 100)) for i in range(3000) for y, x in [(rng.randint(0, 999), rng.randint(0, 999))]]
    fields = [(i, 1, float(a), float(b), float(c), float(d), rng.choice([str(rng.randint(1, 4000)), f"-{rng.randint(1, 90)}", "aab", "ff", "ab", "cccc b"]), rng.choice(["numerical", "text"])) for i in range(400) for (a, c), (b, d) in [(at(2), at(2))]]
    f, t = spark.createDataFrame(fields, FIELDS), spark.createDataFrame(tokens, TOKENS)
    want = quality.tokens_near(f, t).select("field_id", quality.ocr_outcome(F.col("value"), F.col("kind"), F.col("near")).alias("outcome"))
    want = dict(map(tuple, want.collect()))
    assert dict(map(tuple, quality.ocr_outcomes(f, t).select("field_id", "outcome").collect())) == want
    assert len(set(want.values())) >= 4


def test_num06_lists_tokens_of_few_fields(spark, tmp_path, monkeypatch):
    """The query makes a list of near tokens only where one is needed, not for every field."""
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 0.125) for _ in range(8)], i % 2) for i in range(1200)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    listed, tokens_near = [], quality.tokens_near
    monkeypatch.setattr(quality, "tokens_near", lambda f, *more: listed.append(f) or tokens_near(f, *more))
    out = catalog.queries()["num06_ocr_outcomes"](spark, str(tmp_path))
    assert out.count() == 1200 and sum(f.count() for f in listed) < 240
