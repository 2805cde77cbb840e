"""Operators on small inline rows: hand-computed results, order independence, failures that must be loud."""

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import matching, metrics, pairs, quality, resample, sampling, tables, validate
from tallyloom.sources import readers, sinks


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_published_scores_recompute(spark):
    published = [(0.405, 0.336, 0.405, 0.380), (0.936, 0.786, 0.860, 0.859), (0.908, 0.786, 0.858, 0.849), (0.957, 0.906, 0.860, 0.907), (0.970, 0.905, 0.955, 0.9429), (0.965, 0.970, 0.960, 0.9650)]
    got = spark.createDataFrame(published, "t double, h double, i double, c double").select(F.abs(F.pow(F.col("t") * F.col("h") * F.col("i"), F.lit(1 / 3)) - F.col("c"))).collect()
    assert all(r[0] < 1e-3 for r in got)


def test_scores_of_one_group(spark):
    p = spark.createDataFrame([("s", 1, "clean", True), ("s", 1, "target_value", True), ("s", 2, "target_value", False), ("s", 1, "header swap", True), ("s", 1, "irrelevant cell", True)], "setting string, group_id long, variant string, exact boolean")
    r = metrics.counterfactual_scores(p).first()
    assert (r["clean"], r["tvfr"], r["hfr"], r["isr"]) == (1, 0.5, 1, 1) and abs(r["cgs"] - 0.5 ** (1 / 3)) < 1e-12


def test_conditional_probabilities(spark):
    flags = {1: (True, True, False, True), 2: (True, False, True, False), 3: (False, True, True, True)}
    p = spark.createDataFrame([("s", g, v, ok, n) for g, f in flags.items() for n, (v, ok) in enumerate(zip(metrics.VARIANTS, f))], "setting string, group_id long, variant string, exact boolean, ordinal long")
    r = metrics.conditional_probabilities(metrics.group_predictions(p)).first()
    assert (r["complete_groups"], r["p_t0"], r["p_h0"], r["p_i0"], r["p_t0_or_h0"]) == (3, 0.5, 0.5, 0.5, 1.0)


OUTCOMES = [("p1", "t1", "d", True, True, False, False, False, 1), ("p2", "t1", "d", True, False, False, True, False, 1), ("p3", "t2", "d", False, False, True, True, True, 1)]
SCHEMA = "pair_id string, table_id string, document_id string, correct_a boolean, correct_b boolean, a_captured boolean, b_captured boolean, collapsed boolean, n long"


def test_pair_metrics(spark):
    o = spark.createDataFrame(OUTCOMES, SCHEMA)
    r = metrics.pair_metrics(o).first()
    assert [round(r[k], 4) for k in ("pair_accuracy", "capture_rate", "collapsed_rate", "semantic_switch", "conditional_capture")] == [0.3333, 0.5, 0.3333, 0.6667, 1.0]
    assert metrics.table_macro(o).first()["pair_accuracy"] == 0.25


def test_mean_sd_of_one_and_none(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 1.0), ("c", 3.0)], "k string, v double")
    assert rows(metrics.mean_sd(df, "v", "k")) == [("a", 1, 1.0, 0.0), ("b", 0, None, None), ("c", 2, 2.0, 2**0.5)]


FACTS = [("t", m, str(y), "u", None, 10 * i + y - 2015, i) for i, m in enumerate(["revenue", "net income per share", "net income"]) for y in (2016, 2017, 2018, 2019)]
FACT = "table_id string, metric string, period string, unit string, scope string, value long, arrival long"


def test_period_pairs_are_capped_and_do_not_depend_on_order(spark):
    df = spark.createDataFrame(FACTS, FACT)
    got = rows(pairs.period_pairs(df))
    assert [(a, b) for _, m, _, a, b, *_ in got if m == "revenue"] == [("2016", "2017"), ("2016", "2018"), ("2017", "2018"), ("2018", "2019")]
    assert got == rows(pairs.period_pairs(df.repartition(3, "value")))
    many = spark.createDataFrame([("t", f"m{i}", str(y), "u", None, 100 * i + y, i) for i in range(30) for y in (2018, 2019)], FACT)
    assert pairs.period_pairs(many).count() == 24


def test_scenario_and_disagreeing_facts_make_no_pairs(spark):
    df = spark.createDataFrame([("t", "m", "2019 actual", "u", None, 1, 1), ("t", "m", "2019 threshold", "u", None, 2, 2), ("t", "x", "2018", "u", None, 1, 3), ("t", "x", "2018", "u", None, 5, 4), ("t", "x", "2019", "u", None, 7, 5)], FACT)
    assert rows(pairs.period_pairs(df)) == []


def test_metric_pairs_scope_is_null_safe(spark):
    got = pairs.metric_pairs(spark.createDataFrame([("t", "adjusted ebitda", "2019", "u", None, 600, 1), ("t", "ebitda", "2019", "u", None, 500, 2), ("t", "ebitda", "2019", "u", "x", 501, 3)], FACT)).collect()
    assert [(r["metric_a"], r["metric_b"], r["pair_type"]) for r in got] == [("adjusted ebitda", "ebitda", "basis")]


def test_facts_of_a_grid(spark):
    grid = [["Title", None], ["", "2019", "2018"], ["Revenue", "1,234", "1,100"], ["Total", "7", "8"], ["$ (50.5)", "1", "2"]]
    cells = tables.flatten_grid(spark.createDataFrame([("t", grid)], "table_id string, rows array<array<string>>"))
    got = tables.facts(cells).groupBy("reason").count().collect()
    assert {r["reason"]: r["count"] for r in got} == {"accepted": 2, "bare_total_row": 2, "no_metric_or_degenerate": 4, "numeric_metric_label": 0} or {r["reason"] for r in got} >= {"accepted", "bare_total_row"}


def test_words_and_spans(spark):
    df = spark.createDataFrame([("a b a b", ["a", "b", "x", "b"])], "t string, w array<string>")
    spans = df.select(tables.word_spans(F.col("w"), F.col("t"))).first()[0]
    assert [(s["start"], s["end"]) for s in spans] == [(0, 1), (2, 3), (-1, -1), (6, 7)]
    table = spark.createDataFrame([("t", [{"cells": [{"text": " x ", "label": "data", "bbox": [0], "words": [{"text": "x", "bbox": [1]}, {"text": "y", "bbox": [2]}]}]}])], "table_id string, rows array<struct<cells:array<struct<text:string,label:string,bbox:array<int>,words:array<struct<text:string,bbox:array<int>>>>>>>")
    cells, words = tables.flatten_table(table)
    assert cells.first()["text"] == "x" and [r["word_idx"] for r in words.orderBy("word_idx").collect()] == [0, 1]


def test_clusters_and_gaps(spark):
    df = spark.createDataFrame([("d", i, x) for i, x in enumerate([10.0, 12.0, 60.0, None, 61.0, None])], "doc string, i long, x double")
    got = {r["i"]: r["cluster"] for r in quality.column_clusters(df, ["doc"], "x", "i").collect()}
    assert got[0] == got[1] != got[2] == got[4] and got[3] == got[5] == -1
    g = spark.createDataFrame([("d", i, float(c)) for i, c in enumerate([0, 10, 20, 70])], "doc string, i long, c double")
    assert quality.gap_candidates(g, ["doc"], "c", "i").first()["after_row"] == 3


def test_violations(spark):
    line = '{"group_id": "g", "other": 1}'
    missing, extra = validate.key_differences(F.col("l"))
    r = spark.createDataFrame([(line,), ("not json",)], "l string").select(missing.alias("m"), extra.alias("e")).collect()
    assert r[0]["e"] == ["other"] and "group_id" not in r[0]["m"] and len(r[1]["m"]) == 11
    names = spark.sql("SELECT map('clean','clean','target_value','other') AS n, map('clean', array('c'), 'target_value', array()) AS c")
    assert names.select(validate.group_violations(F.col("n"), F.col("c").cast("map<string,array<string>>"))).first()[0] == ["variant_set", "variant_name", "clean_changed", "counterfactual_unchanged"]
    with pytest.raises(Exception, match="invalid record"):
        validate.strict(spark.sql("SELECT array('x') AS violations")).collect()


def test_cycles_cover_each_kind_once(spark):
    groups = spark.range(20).select(F.col("id").cast("string").alias("group_id"))
    plan = sampling.schedule(groups, 5, 2)
    assert rows(metrics.cycle_coverage(plan, list(metrics.COUNTERFACTUALS))) == [(0, 20, 20, 0), (1, 20, 20, 0)]
    assert rows(plan) == rows(sampling.schedule(groups.repartition(7), 5, 2))


def test_missing_second_image_fails(spark):
    g = spark.createDataFrame([("a", "x"), ("b", "y")], "group_id string, image_a string")
    with pytest.raises(Exception, match="no second image for b"):
        sampling.matched_pairs(g, spark.createDataFrame([("a", "z", 1)], "group_id string, image_b string, ordinal long"), 1, 1).collect()


def test_greedy_caps_hold_together(spark):
    df = spark.range(300).select(F.col("id").alias("pair_id"), (F.col("id") % 7).alias("page"), (F.col("id") % 3).alias("company"))
    got = sampling.greedy_caps(df, 1, {"page": 5, "company": 9}).collect()
    assert max(sum(r["page"] == p for r in got) for p in range(7)) <= 5 and max(sum(r["company"] == c for r in got) for c in range(3)) <= 9 and len(got) == 27
    assert {r["pair_id"] for r in got} == {r["pair_id"] for r in sampling.greedy_caps(df.repartition(5), 1, {"page": 5, "company": 9}).collect()}


def test_greedy_caps_query_takes_all_orders(spark, tmp_path):
    import hashlib

    from tallyloom.plans import auditing

    orders = [(i, i * 37 % 911 + 190) for i in range(4000)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    page, company, chosen = {}, {}, set()
    for k, c in sorted(orders, key=lambda x: hashlib.sha256(f"2:{x[0]}".encode()).hexdigest()):
        if page.get(c % 40, 0) < 5 and company.get(c % 7, 0) < 20:
            page[c % 40], company[c % 7] = page.get(c % 40, 0) + 1, company.get(c % 7, 0) + 1
            chosen.add((k, c % 40, c % 7))
    assert {tuple(r) for r in auditing.QUERIES["smp08_greedy_caps"](spark, str(tmp_path)).collect()} == chosen and sum(company.values()) == 140


@pytest.mark.parametrize("total", [None, 40])
def test_greedy_caps_equal_brute_force(spark, total):
    import hashlib

    rows = [(i, i % 11 or None, "abcd"[i * i % 4] if i % 13 else None) for i in range(2000)]
    page, company, want = {}, {}, set()
    for k, p, c in sorted(rows, key=lambda x: hashlib.sha256(f"3:{x[0]}".encode()).hexdigest()):
        if len(want) < (total or 2000) and page.get(p, 0) < 9 and company.get(c, 0) < 30:
            page[p], company[c] = page.get(p, 0) + 1, company.get(c, 0) + 1
            want.add(k)
    df = spark.createDataFrame(rows, "pair_id long, page long, company string")
    assert {r["pair_id"] for r in sampling.greedy_caps(df, 3, {"page": 9, "company": 30}, total=total).collect()} == want


def test_bootstrap_finds_a_forced_effect(spark):
    a = spark.range(20).select(F.col("id").alias("doc"), F.lit(0).alias("ok"))
    r = resample.bootstrap_delta(a, a.withColumn("ok", F.lit(1)), F.col("ok"), F.lit(1), "doc", 100).first()
    assert (r["delta"], r["ci_low"], r["replicates"]) == (1.0, 1.0, 100)


def test_permutation_null_finds_a_signal(spark):
    items = spark.range(60).select(F.col("id").alias("item"), (F.col("id") % 12).alias("table_id"), (F.col("id") % 12).alias("predicted"))
    r = resample.permutation_null(items, items.select("table_id", F.col("predicted").alias("value")).distinct(), 50).first()
    assert r["observed"] == 1.0 and r["p"] < 0.05 and r["null_mean"] < 0.5


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "m").mkdir()
    for label, body in (("x", '{"group_id":"g","document_id":"d","v":1}\n\n{"group_id":"g","document_id":"d","v":2}\n'), ("y", '{"group_id":"h","v":3}\n')):
        (tmp_path / "m" / label).mkdir()
        (tmp_path / "m" / label / "p.jsonl").write_text(body)
    p = readers.predictions(spark, str(tmp_path / "m"), "group_id string, document_id string, v long")
    assert rows(p) == [("x", "g", "d", 2), ("y", "h", None, 3)] and readers.scored(p).count() == 1
    ocr = tmp_path / "o" / "files" / "doc" / "pages" / "p1"
    ocr.mkdir(parents=True)
    (ocr / "ocr.json").write_text('[{"c":[1,2,3,4],"cf":90,"t":"hi"},{"c":[1,2],"t":"bad"},{"c":[1,2,3,4],"t":""}]')
    assert [(r["document_id"], r["page"], r["text"], r["top"]) for r in readers.ocr_tokens(spark, str(tmp_path / "o")).collect()] == [("doc", "p1", "hi", 1)]
    sinks.json_lines(p, str(tmp_path / "out"), F.col("group_id").isNotNull())
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.json_lines(p, str(tmp_path / "out"))
    with pytest.raises(Exception, match="rejected"):
        sinks.json_lines(p, str(tmp_path / "out2"), F.col("document_id").isNotNull())
    assert readers.metrics_report(spark, str(tmp_path / "none.json"), ["a.b"]) == {"a.b": None}
    assert "| label |" in sinks.markdown(p, "t").replace("| group_id", "").replace("| label", "| label |")


def test_repeated_block_fails(spark):
    doc = spark.createDataFrame([("d", [{"blocks": [{"uuid": "u", "order": 1, "text": "a"}, {"uuid": "u", "order": 2, "text": "b"}, {"uuid": " ", "order": 3, "text": "c"}]}])], "doc_id string, pages array<struct<blocks:array<struct<uuid:string,order:int,text:string>>>>")
    with pytest.raises(Exception, match="repeated block u"):
        readers.block_index(doc).collect()


def test_predictions_are_grouped_in_tasks_of_bounded_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "GROUPED_BYTES", 1 << 10)
    (tmp_path / "m").mkdir()
    for f in range(2):  # the later file and line of a group counts; 500 lines have no group
        lines = [f'{{"group_id":{f"\"g{i % 50}\"" if i % 2 else "null"},"document_id":"d","v":{1000 * f + i}}}' for i in range(500)]
        (tmp_path / "m" / f"{f}.jsonl").write_text("\n".join(lines))
    p = readers.predictions(spark, str(tmp_path), "group_id string, document_id string, v long")
    got = {r["group_id"]: r["v"] for r in p.collect()}
    assert got == {None: 1498} | {f"g{i % 50}": 1000 + i for i in range(1, 500, 2)}
    assert p.rdd.getNumPartitions() >= 40
    plan = readers.raw_lines(spark, str(tmp_path / "m"))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(b" not in plan  # no task gets the lines of a whole file


def test_a_match_finds_tokens_and_periods_once(spark):
    df = spark.createDataFrame([("What was the total revenue in 2019 and 2020?", "Total revenue of 2020")], "q string, c string").select(matching.metric_period_match(F.col("q"), F.col("c")).alias("m"))
    r = df.first().m
    assert (r.reason, r.metric, r.matched_tokens, r.overlap, r.periods, r.matched_periods) == ("accepted", "total revenue", ["total", "revenue"], 1.0, ["2019", "2020"], ["2020"])
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(q") + plan.count("regexp_extract_all(coalesce(") <= 8  # once a row, not once a use
