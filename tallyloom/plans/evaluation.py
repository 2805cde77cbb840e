"""Queries over predictions and pair outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import rate
from ..functions.text import canonical_variant
from ..operators import metrics as m
from .carriers import FACTS_SQL, OUTCOMES_SQL, PREDICTIONS_SQL, facts, outcomes, predictions, table

QUERIES, SQL = {}, {}


def add(name, query, sql):
    QUERIES[name], SQL[name] = query, sql


P, O = PREDICTIONS_SQL, OUTCOMES_SQL
ratio = lambda a, b: f"(CASE WHEN {b} <> 0 THEN ({a})::DOUBLE / ({b}) END)"
cnt = lambda c: f"count(*) FILTER (WHERE {c})"

add(
    "agg01_accuracy",
    lambda s, d: m.accuracy(predictions(s, d)).drop("level"),
    f"WITH {P} SELECT setting, variant, count(*) AS total, {cnt('exact')} AS exact_correct, {cnt('numeric')} AS numeric_correct, {cnt('exact')}::DOUBLE / count(*) AS exact_accuracy, {cnt('numeric')}::DOUBLE / count(*) AS numeric_accuracy FROM predictions GROUP BY GROUPING SETS ((), (setting), (setting, variant))",
)
add(
    "agg02_prediction_summary",
    lambda s, d: m.prediction_summary(predictions(s, d)).drop("level"),
    f"WITH {P} SELECT setting, coalesce(nullif(scale, ''), 'none') AS scale, count(*) AS total, {cnt('exact')} AS exact_correct, {cnt('numeric')} AS numeric_correct FROM predictions GROUP BY setting, 2 UNION ALL SELECT setting, NULL, count(*), {cnt('exact')}, {cnt('numeric')} FROM predictions GROUP BY setting UNION ALL SELECT NULL, NULL, count(*), {cnt('exact')}, {cnt('numeric')} FROM predictions",
)
_rate = lambda v: ratio(cnt(f"variant = '{v}' AND exact"), cnt(f"variant = '{v}'"))
add(
    "agg03_cgs_by_setting",
    lambda s, d: m.counterfactual_scores(predictions(s, d)).withColumn("cgs", F.round("cgs", 9)),
    f"WITH {P}, r AS (SELECT setting, {_rate('clean')} AS clean, {_rate('target_value')} AS tvfr, {_rate('header_address_swap')} AS hfr, {_rate('irrelevant_value')} AS isr FROM predictions GROUP BY setting) SELECT *, round(pow(tvfr * hfr * isr, 1.0 / 3), 9) AS cgs FROM r",
)
_first = f"WITH {P}, f AS (SELECT setting, group_id, variant, arg_min(exact, ordinal) AS correct, count(*) - 1 AS again FROM predictions GROUP BY ALL), g AS (SELECT setting, group_id, " + ", ".join(f"bool_or(correct) FILTER (WHERE variant = '{v}') AS {v}" for v in m.VARIANTS) + ", sum(again)::BIGINT AS duplicates FROM f GROUP BY ALL)"
add("agg04_group_predictions", lambda s, d: m.group_predictions(predictions(s, d)), _first + " SELECT * FROM g")
_all = " AND ".join(f"{v} IS NOT NULL" for v in m.VARIANTS)
_p = lambda c: ratio(cnt(f"{_all} AND clean AND ({c})"), cnt(f"{_all} AND clean"))
_cond = f"c AS (SELECT setting, {cnt(_all)} AS complete_groups, {cnt(_all + ' AND clean')} AS clean_correct_groups, {_p('NOT target_value')} AS p_t0, {_p('NOT header_address_swap')} AS p_h0, {_p('NOT target_value OR NOT header_address_swap')} AS p_t0_or_h0, {_p('NOT irrelevant_value')} AS p_i0 FROM g GROUP BY setting)"
add(
    "agg05_conditional_probabilities",
    lambda s, d: m.conditional_probabilities(m.group_predictions(predictions(s, d))),
    f"{_first}, {_cond} SELECT *, " + ", ".join(f"{k} - p_i0 AS {k}_minus_i0, {k} > p_i0 AS {k}_exceeds_i0" for k in ("p_t0", "p_h0", "p_t0_or_h0")) + " FROM c",
)


def _grounded(s, d):
    return predictions(s, d).select(canonical_variant(F.col("variant")).alias("variant"), "group_id", F.col("exact").alias("row_ok"), F.col("numeric").alias("column_ok"), (F.col("ordinal.l_partkey") % 3 == 0).alias("answer_ok"), (F.col("ordinal.l_linenumber") / 10).alias("iou"), F.col("exact").alias("evidence_ok"))


_G = f"{P}, g AS (SELECT CASE l_linenumber % 4 WHEN 0 THEN 'clean' WHEN 1 THEN 'target_value' WHEN 2 THEN 'header_address_swap' ELSE 'irrelevant_value' END AS variant, l_orderkey AS group_id, l_discount < 0.05 AS row_ok, l_discount < 0.06 AS column_ok, l_partkey % 3 = 0 AS answer_ok, l_linenumber / 10 AS iou, l_discount < 0.05 AS evidence_ok FROM lineitem)"
add(
    "agg06_grounding_metrics",
    lambda s, d: m.grounding(_grounded(s, d)).withColumn("mean_iou", F.round("mean_iou", 9)),
    f"WITH {_G} SELECT variant, count(*) AS n, {ratio(cnt('row_ok'), 'count(*)')} AS row_accuracy, {ratio(cnt('column_ok'), 'count(*)')} AS column_accuracy, {ratio(cnt('row_ok AND column_ok'), 'count(*)')} AS cell_accuracy, round(avg(iou), 9) AS mean_iou, median(iou) AS median_iou, {ratio(cnt('answer_ok AND row_ok AND column_ok'), 'count(*)')} AS p_answer_and_cell, {ratio(cnt('answer_ok AND row_ok AND column_ok'), cnt('answer_ok'))} AS p_cell_given_answer FROM g GROUP BY variant",
)
_e, _a = "evidence_ok", "answer_ok"
add(
    "agg07_evidence_confusion",
    lambda s, d: m.confusion(_grounded(s, d)),
    f"WITH {_G} SELECT variant, {cnt('evidence_ok AND answer_ok')} AS both, {cnt('evidence_ok AND NOT answer_ok')} AS evidence_only, {cnt('NOT evidence_ok AND answer_ok')} AS answer_only, {cnt('NOT evidence_ok AND NOT answer_ok')} AS neither, {ratio(cnt('evidence_ok AND answer_ok'), cnt('evidence_ok'))} AS p_answer_given_evidence, {ratio(cnt('NOT evidence_ok AND answer_ok'), cnt('NOT evidence_ok'))} AS p_answer_given_no_evidence, {ratio(cnt('evidence_ok AND answer_ok'), cnt('answer_ok'))} AS p_evidence_given_answer, {ratio(cnt('evidence_ok AND NOT answer_ok'), cnt('NOT answer_ok'))} AS p_evidence_given_no_answer FROM g GROUP BY variant",
)
add(
    "agg08_error_buckets",
    lambda s, d: m.error_buckets(_grounded(s, d), "header_address_swap"),
    f"WITH {_G} SELECT CASE WHEN evidence_ok AND answer_ok THEN 'A' WHEN evidence_ok THEN 'B' WHEN answer_ok THEN 'C' ELSE 'D' END AS bucket, count(*) AS n, min(group_id) AS first_group, max(group_id) AS last_group FROM g WHERE variant = 'header_address_swap' GROUP BY 1",
)
add(
    "agg08_error_groups",
    lambda s, d: m.error_groups(_grounded(s, d), "header_address_swap"),
    f"WITH {_G} SELECT CASE WHEN evidence_ok AND answer_ok THEN 'A' WHEN evidence_ok THEN 'B' WHEN answer_ok THEN 'C' ELSE 'D' END AS bucket, group_id FROM g WHERE variant = 'header_address_swap'",
)
_PM = {
    "individual_accuracy": (cnt("correct_a") + " + " + cnt("correct_b"), "count(*) * 2"),
    "pair_accuracy": (cnt("correct_a AND correct_b"), "count(*)"),
    "capture_rate": (cnt("a_captured") + " + " + cnt("b_captured"), "count(*) * 2"),
    "collapsed_rate": (cnt("collapsed"), "count(*)"),
    "conditional_capture": (cnt("correct_a AND b_captured") + " + " + cnt("correct_b AND a_captured"), cnt("correct_a AND NOT correct_b") + " + " + cnt("correct_b AND NOT correct_a")),
    "semantic_switch": ("count(*) - " + cnt("collapsed"), "count(*)"),
}
_pm = ", ".join(f"{ratio(x, y)} AS {k}" for k, (x, y) in _PM.items())
add("agg09_pair_metrics", lambda s, d: m.pair_metrics(outcomes(s, d), "document_id"), f"WITH {O} SELECT document_id, count(*) AS pairs, {_pm} FROM outcomes GROUP BY document_id")
add(
    "agg10_table_macro",
    lambda s, d: m.table_macro(outcomes(s, d)).select("tables", *(F.round(k, 9).alias(k) for k in m.pair_sums())),
    f"WITH {O}, t AS (SELECT table_id, {_pm} FROM outcomes GROUP BY table_id) SELECT count(*) AS tables, " + ", ".join(f"round(avg({k}), 9) AS {k}" for k in _PM) + " FROM t",
)


def _sides(s, d):
    return m.pair_sides(outcomes(s, d)).withColumn("scale_shift", F.col("n") % 3 == 0).withColumn("other_cell", F.col("n") % 4 == 1)


_S = f"{O}, sides AS (SELECT pair_id, table_id, document_id, n, 'a' AS side, correct_a AS correct, a_captured AS captured FROM outcomes UNION ALL SELECT pair_id, table_id, document_id, n, 'b', correct_b, b_captured FROM outcomes)"
add("prj14_pair_sides", lambda s, d: m.pair_sides(outcomes(s, d)), f"WITH {_S} SELECT * FROM sides")
add(
    "agg11_error_taxonomy",
    lambda s, d: m.error_taxonomy(_sides(s, d)),
    f"WITH {_S}, w AS (SELECT CASE WHEN captured THEN 'captured' WHEN n % 3 = 0 THEN 'scale_shift' WHEN n % 4 = 1 THEN 'other_cell' ELSE 'unexplained' END AS mode FROM sides WHERE NOT correct) SELECT k AS mode, (SELECT count(*) FROM w WHERE mode = k)::BIGINT AS n FROM (VALUES ('captured'), ('scale_shift'), ('other_cell'), ('unexplained')) v(k)",
)
add(
    "agg12_rescue_regression",
    lambda s, d: m.rescue_regression(outcomes(s, d).select("pair_id", F.col("correct_a").alias("correct")), outcomes(s, d).select("pair_id", F.col("correct_b").alias("correct"))),
    f"WITH {O} SELECT {cnt('correct_a AND correct_b')} AS both, {cnt('correct_a AND NOT correct_b')} AS lost, {cnt('NOT correct_a AND correct_b')} AS rescued, {cnt('NOT correct_a AND NOT correct_b')} AS neither, {ratio(cnt('NOT correct_a AND correct_b'), cnt('NOT correct_a'))} AS rescue_rate, {ratio(cnt('correct_a AND NOT correct_b'), cnt('correct_a'))} AS regression_rate FROM outcomes",
)
add(
    "agg13_mean_sd",
    lambda s, d: m.mean_sd(table(s, d, "supplier").withColumn("v", F.when(F.col("s_acctbal") > 0, F.col("s_acctbal"))), "v", "s_nationkey").select("s_nationkey", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd")),
    "SELECT s_nationkey, count(v) AS n, round(avg(v), 6) AS mean, round(CASE WHEN count(v) = 1 THEN 0 ELSE stddev_samp(v) END, 6) AS sd FROM (SELECT *, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS v FROM supplier) GROUP BY s_nationkey",
)


def _valued(s, d):
    return m.pair_sides(outcomes(s, d)).withColumn("gold", F.col("n") % 50).withColumn("predicted", F.col("n") % 53)


_V = f"{_S}, v AS (SELECT *, n % 50 AS gold, n % 53 AS predicted FROM sides)"
add(
    "agg14_other_cell_rate",
    lambda s, d: m.other_cell_rate(_valued(s, d)),
    f"WITH {_V}, w AS (SELECT EXISTS (SELECT 1 FROM v k WHERE k.table_id = v.table_id AND k.gold = v.predicted) AS hit FROM v WHERE NOT correct AND NOT captured) SELECT count(*) AS items, {cnt('hit')} AS hits, {ratio(cnt('hit'), 'count(*)')} AS rate FROM w",
)
add("agg27_table_values", lambda s, d: m.table_values(_valued(s, d)), f"WITH {_V} SELECT DISTINCT table_id, gold AS value FROM v")
add(
    "agg22_last_wins",
    lambda s, d: m.last_wins(predictions(s, d).select("setting", "group_id", canonical_variant(F.col("variant")).alias("variant"), "exact", F.struct("ordinal.l_linenumber", "ordinal.l_partkey", "ordinal.l_suppkey", "ordinal.l_extendedprice", "ordinal.l_shipdate").alias("o")), ["setting", "group_id", "variant"], "o").drop("o"),
    f"WITH {P} SELECT setting, group_id, variant, arg_max(exact, ordinal) AS exact FROM predictions GROUP BY ALL",
)
add(
    "agg23_coverage",
    lambda s, d: m.coverage(facts(s, d)),
    f"WITH {FACTS_SQL}, t AS (SELECT table_id, count(*) AS n FROM facts GROUP BY 1), l AS (SELECT list(n ORDER BY n) AS s, count(*) AS tables, sum(n)::BIGINT AS pairs, median(n) AS median, max(n) AS most FROM t) SELECT tables, pairs, median, most, s[floor(0.25 * (len(s) - 1))::INT + 1] AS p25, s[floor(0.75 * (len(s) - 1))::INT + 1] AS p75 FROM l",
)
add(
    "agg24_per_document",
    lambda s, d: m.per_document(facts(s, d), "table_id").withColumn("mean", F.round("mean", 3)),
    f"WITH {FACTS_SQL}, t AS (SELECT table_id, count(*) AS n FROM facts GROUP BY 1), l AS (SELECT list(n ORDER BY n) AS s, min(n) AS least, max(n) AS most, round(avg(n), 3) AS mean FROM t) SELECT least, most, mean, s[floor(len(s) / 2)::INT + 1] AS upper_median FROM l",
)
add("srt04_top_documents", lambda s, d: m.top(table(s, d, "events"), "user_id"), "SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10")
add(
    "agg25_funnel",
    lambda s, d: m.funnel(table(s, d, "orders").select(F.col("o_orderstatus").alias("reason"), F.col("o_orderpriority").alias("split"))).drop("level"),
    "SELECT o_orderpriority AS split, o_orderstatus AS reason, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority, o_orderstatus))",
)
add(
    "agg26_cycle_coverage",
    lambda s, d: m.cycle_coverage(table(s, d, "lineitem").select((F.col("l_linenumber") % 2).alias("cycle"), F.col("l_orderkey").alias("group_id"), F.col("l_returnflag").alias("kind")), ["A", "N", "R"]),
    f"WITH g AS (SELECT l_linenumber % 2 AS cycle, l_orderkey, string_agg(l_returnflag, '' ORDER BY l_returnflag) AS seen, count(*) - count(DISTINCT l_returnflag) AS again FROM lineitem GROUP BY 1, 2) SELECT cycle, count(*) AS groups, {cnt(chr(39).join(['seen = ', 'ANR', '']))} AS covered, sum(again)::BIGINT AS duplicates FROM g GROUP BY 1",
)
add(
    "agg28_unique_questions",
    lambda s, d: m.first_wins(table(s, d, "conversations").where("role = 'user'").select(F.col("text").alias("question"), "conv_id", F.struct("conv_id", "turn").alias("o")), ["question"], "o").drop("o"),
    "SELECT text AS question, arg_min(conv_id, (conv_id, turn)) AS conv_id FROM conversations WHERE role = 'user' GROUP BY 1",
)


def _deltas(s, d):
    return table(s, d, "supplier").select(F.col("s_nationkey").alias("method"), (F.col("s_acctbal") / 1e4).alias("delta"), ((F.col("s_acctbal") + 500) / 1e4).alias("ci_low"), (-F.col("s_acctbal") / 2e4).alias("capture_delta"))


add(
    "agg30_significance",
    lambda s, d: m.significant(_deltas(s, d), "method").withColumn("mean_delta", F.round("mean_delta", 9)),
    "SELECT s_nationkey AS method, count(*) AS seeds, round(avg(s_acctbal / 1e4), 9) AS mean_delta, bool_and((s_acctbal + 500) / 1e4 > 0) AS significant, avg(-s_acctbal / 2e4) <= 0 AS capture_no_worse FROM supplier GROUP BY 1",
)
add(
    "agg31_decision",
    lambda s, d: m.decision(m.counterfactual_scores(predictions(s, d)).withColumn("ref_cgs", F.lit(0.45)).withColumn("ref_clean", F.col("clean") - 0.001 * F.ascii("setting"))).select("setting", "case"),
    f"WITH {P}, r AS (SELECT setting, {_rate('clean')} AS clean, pow({_rate('target_value')} * {_rate('header_address_swap')} * {_rate('irrelevant_value')}, 1.0 / 3) AS cgs FROM predictions GROUP BY setting) SELECT setting, CASE WHEN cgs - 0.45 > 0 AND -0.001 * ascii(setting) <= 0.02 THEN 'A' WHEN cgs - 0.45 >= -0.01 AND -0.001 * ascii(setting) <= 0.02 THEN 'B' ELSE 'C' END AS \"case\" FROM r",
)
add(
    "agg33_metric_matrix",
    lambda s, d: m.pair_metrics(outcomes(s, d).withColumn("seed", F.col("pair_id") % 3).withColumn("view", F.when(F.col("n") % 2 == 0, "adjacent").otherwise("skip")), "document_id", "seed", "view"),
    f"WITH {O} SELECT document_id, pair_id % 3 AS seed, CASE WHEN n % 2 = 0 THEN 'adjacent' ELSE 'skip' END AS view, count(*) AS pairs, {_pm} FROM outcomes GROUP BY 1, 2, 3",
)
add(
    "flt15_group_prefix",
    lambda s, d: m.dense_prefix(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey", 20),
    "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT DISTINCT l_orderkey FROM lineitem ORDER BY 1 LIMIT 20)",
)
add(
    "flt16_records_for_view",
    lambda s, d: outcomes(s, d).withColumn("view", F.when(F.col("n") % 2 == 0, "adjacent").otherwise("skip")).where("view = 'adjacent'").groupBy("table_id").agg(F.count("*").alias("n"), rate(F.count_if("correct_a"), F.count("*")).alias("accuracy")),
    f"WITH {O} SELECT table_id, count(*) AS n, {ratio(cnt('correct_a'), 'count(*)')} AS accuracy FROM outcomes WHERE n % 2 = 0 GROUP BY 1",
)
