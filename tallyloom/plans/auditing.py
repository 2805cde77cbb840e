"""Queries over two-sided data, spatial joins, validation, sampling, resampling, sets and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as q
from ..operators import resample as r
from ..operators import sampling as sm
from ..operators import validate as v
from ..operators.metrics import COUNTERFACTUALS
from ..streaming import visits
from .carriers import BOXES_SQL, OUTCOMES_SQL, boxes, outcomes, table

QUERIES, SQL = {}, {}


def add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def _sides(s, d):
    left = table(s, d, "customer").select(F.col("c_nationkey").alias("document"), (F.col("c_custkey") % 20).alias("company"), "c_custkey", "c_acctbal")
    right = table(s, d, "supplier").select(F.col("s_nationkey").alias("document"), (F.col("s_suppkey") % 20).alias("company"), "s_suppkey", "s_acctbal")
    return left.withColumnRenamed("c_custkey", "k").withColumnRenamed("c_acctbal", "x"), right.withColumnRenamed("s_suppkey", "k").withColumnRenamed("s_acctbal", "x")


add(
    "join04_two_sided",
    lambda s, d: q.two_sided(*_sides(s, d), ["document", "company"], "k").select("document", "company", F.coalesce("left.k", F.lit(-1)).alias("left_k"), F.coalesce("right.k", F.lit(-1)).alias("right_k"), "matched", F.col("unmatched_left").cast("bigint").alias("unmatched_left"), F.col("unmatched_right").cast("bigint").alias("unmatched_right")),
    "WITH l AS (SELECT c_nationkey AS document, c_custkey % 20 AS company, min(c_custkey) AS k, count(*) AS n FROM customer GROUP BY 1, 2), r AS (SELECT s_nationkey AS document, s_suppkey % 20 AS company, min(s_suppkey) AS k, count(*) AS n FROM supplier GROUP BY 1, 2) SELECT document, company, coalesce(l.k, -1) AS left_k, coalesce(r.k, -1) AS right_k, l.k IS NOT NULL AND r.k IS NOT NULL AS matched, coalesce(l.n, 0) - (l.k IS NOT NULL AND r.k IS NOT NULL)::INT AS unmatched_left, coalesce(r.n, 0) - (l.k IS NOT NULL AND r.k IS NOT NULL)::INT AS unmatched_right FROM l FULL JOIN r USING (document, company)",
)
MAPPING = [("revenue", "sales", "monetary"), ("name", "name", "text"), ("size", "size", "numerical")]


def _compared(s, d):
    k = F.col("p_partkey")
    size = F.col("p_size").cast("string")
    left = F.create_map(F.lit("revenue"), size, F.lit("name"), F.col("p_brand"), F.lit("size"), size)
    right = F.create_map(F.lit("sales"), F.when(k % 3 == 0, F.concat(size, F.lit(",000"))).when(k % 3 == 1, size).otherwise(F.lit("1")), F.lit("name"), F.when(k % 2 == 0, F.concat(F.lit("X, "), "p_brand")).otherwise(F.lower("p_brand")), F.lit("size"), F.when(k % 5 == 0, "").otherwise(size))
    return q.compare_fields(table(s, d, "part").select("p_partkey", left.alias("left_values"), right.alias("right_values")), q.field_mapping(s, MAPPING), ["p_partkey"])


_C = """c AS (SELECT p_partkey, 'revenue' AS field, CASE WHEN p_partkey % 3 = 0 THEN 'scale_mismatch' WHEN p_partkey % 3 = 1 OR p_size = 1 THEN 'match' WHEN p_size BETWEEN 980 AND 1020 THEN 'scale_mismatch' ELSE 'mismatch' END AS status FROM part
  UNION ALL SELECT p_partkey, 'name', CASE WHEN p_partkey % 2 = 0 THEN 'granularity_mismatch' ELSE 'match' END FROM part UNION ALL SELECT p_partkey, 'size', 'match' FROM part WHERE p_partkey % 5 <> 0)"""
add("join05_field_comparison", _compared, f"WITH {_C} SELECT * FROM c")
_n = lambda st: f"count(*) FILTER (WHERE status = '{st}')"
add(
    "agg16_audit_summary",
    lambda s, d: q.audit_summary(_compared(s, d)),
    f"WITH {_C}, a AS (SELECT field, count(*) AS compared, {', '.join(f'{_n(t)} AS {t}' for t in q.STATUSES)} FROM c GROUP BY field) SELECT *, CASE WHEN match + mismatch > 0 THEN mismatch::DOUBLE / (match + mismatch) END AS mismatch_rate, scale_mismatch::DOUBLE / compared AS scale_rate, granularity_mismatch::DOUBLE / compared AS granularity_rate FROM a",
)


def _maps(s, d):
    k = F.col("c_custkey")
    return table(s, d, "customer").select("c_custkey", F.map_filter(F.create_map(F.lit("a"), F.when(k % 2 == 0, "x"), F.lit("b"), F.when(k % 3 == 0, "y"), F.lit("c"), F.lit(" ")), lambda _, x: x.isNotNull()).alias("values"))


_B = "p AS (SELECT count(*) AS total, count(*) FILTER (WHERE c_custkey % 2 = 0) AS a, count(*) FILTER (WHERE c_custkey % 3 = 0) AS b FROM customer)"
add("agg15_completeness", lambda s, d: q.completeness(_maps(s, d), ["a", "b", "c"]).drop("level"), f"WITH {_B}, f AS (SELECT 'a' AS field, a AS present, total FROM p UNION ALL SELECT 'b', b, total FROM p UNION ALL SELECT 'c', 0, total FROM p) SELECT field, sum(present)::BIGINT AS present, sum(total)::BIGINT AS total, sum(present)::DOUBLE / sum(total) AS rate FROM f GROUP BY GROUPING SETS ((), (field))")
add("agg21_co_occurrence", lambda s, d: q.co_occurrence(_maps(s, d), [("a", "b"), ("b", "c"), ("a", "z")]), "SELECT a, b, n FROM (SELECT 'a' AS a, 'b' AS b, count(*) FILTER (WHERE c_custkey % 6 = 0) AS n FROM customer UNION ALL SELECT 'b', 'c', count(*) FILTER (WHERE c_custkey % 3 = 0) FROM customer UNION ALL SELECT 'a', 'z', 0)")


def _page(s, d):
    b = boxes(s, d)
    fields = b.select(F.col("vec_id").alias("field_id"), F.col("label").alias("page"), F.col("a")[1].alias("top"), F.col("a")[0].alias("left"), F.col("a")[3].alias("bottom"), F.col("a")[2].alias("right"), F.col("vec_id").cast("string").alias("value"), F.when(F.col("vec_id") % 2 == 0, "numerical").otherwise("text").alias("kind"))
    tokens = b.select(F.col("label").alias("page"), F.col("b")[1].alias("top"), F.col("b")[0].alias("left"), F.col("b")[3].alias("bottom"), F.col("b")[2].alias("right"), F.col("vec_id").alias("ordinal"), (F.col("vec_id") % 50).cast("string").alias("text"), (F.col("vec_id") % 100).cast("int").alias("confidence"))
    return fields, tokens


_T = f"""{BOXES_SQL}, near AS (SELECT f.vec_id AS field_id, f.label AS page, list(t.vec_id % 50 ORDER BY t.b[1], t.vec_id) FILTER (WHERE t.vec_id IS NOT NULL) AS near, avg(t.vec_id % 100) AS conf
  FROM boxes f LEFT JOIN boxes t ON f.label = t.label AND (t.b[2] + t.b[4]) / 2 BETWEEN f.a[2] - 8 AND f.a[4] + 8 AND (t.b[1] + t.b[3]) / 2 BETWEEN f.a[1] - 8 AND f.a[3] + 8 GROUP BY 1, 2)"""
add("join06_tokens_near", lambda s, d: q.tokens_near(*_page(s, d)).select("field_id", F.array_join(F.transform("near", lambda t: t.text), " ").alias("near")), f"WITH {_T} SELECT field_id, coalesce(array_to_string(near, ' '), '') AS near FROM near")
_rel = " OR ".join(f"abs(v / x - {f!r}) <= {f * t!r} OR abs(v / x - {1 / f!r}) <= {1 / f * t!r}" for f, t in ((10.0, 0.0005), (100.0, 0.0005), (1000.0, 0.02), (1e6, 0.02)))
add(
    "num06_ocr_outcomes",
    lambda s, d: q.ocr_outcomes(*_page(s, d)).select("field_id", "outcome"),
    f"""WITH {_T}, m AS (SELECT field_id, near, conf, field_id::DOUBLE AS v, coalesce(array_to_string(near, ' '), '') AS j FROM near)
SELECT field_id, CASE WHEN near IS NULL THEN 'no_ocr_nearby' WHEN field_id % 2 = 0 THEN CASE WHEN EXISTS (SELECT 1 FROM unnest(near) u(x) WHERE x = v) THEN 'match'
  WHEN EXISTS (SELECT 1 FROM unnest(near) u(x) WHERE x <> 0 AND (abs(v + x) <= abs(x) * 0.02 OR {_rel})) THEN 'match_scale_or_sign' WHEN conf < 60 THEN 'mismatch_low_ocr_confidence' ELSE 'mismatch' END
  WHEN contains(j, field_id::VARCHAR) OR contains(field_id::VARCHAR, j) THEN 'match' WHEN conf < 60 THEN 'mismatch_low_ocr_confidence' ELSE 'mismatch' END AS outcome FROM m""",
)
add("agg18_outcome_summary", lambda s, d: q.outcome_summary(table(s, d, "orders").select(F.col("o_orderstatus").alias("field"), F.col("o_orderpriority").alias("outcome"))).drop("level"), "SELECT field, outcome, n, n::DOUBLE / sum(n) OVER (PARTITION BY field) AS share FROM (SELECT o_orderstatus AS field, o_orderpriority AS outcome, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderpriority), (o_orderstatus, o_orderpriority)))")


def _placed(s, d):
    return table(s, d, "events").select("user_id", "event_id", F.when(F.col("event_id") % 9 != 0, F.col("value")).alias("x"), (F.col("event_id") % 3).alias("m1"), F.when(F.col("event_id") % 2 == 0, 1).alias("m2"))


_X = """e AS (SELECT user_id, event_id, CASE WHEN event_id % 9 <> 0 THEN value END AS x, event_id % 3 AS m1, CASE WHEN event_id % 2 = 0 THEN 1 END AS m2 FROM events),
s AS (SELECT *, coalesce((x - lag(x) OVER w > 5)::INT, 0) AS st FROM e WINDOW w AS (PARTITION BY user_id ORDER BY x NULLS LAST, event_id)),
k AS (SELECT * EXCLUDE st, CASE WHEN x IS NULL THEN -1 ELSE sum(st) OVER (PARTITION BY user_id ORDER BY x NULLS LAST, event_id) END::BIGINT AS cluster FROM s)"""
_clustered = lambda s, d: q.column_clusters(_placed(s, d), ["user_id"], "x", "event_id", 5.0)
add("win04_column_clusters", lambda s, d: _clustered(s, d).select("user_id", "event_id", F.col("cluster").cast("bigint").alias("cluster")), f"WITH {_X} SELECT user_id, event_id, cluster FROM k")
add("agg19_cluster_agreement", lambda s, d: q.cluster_agreement(_clustered(s, d), ["user_id"], ["m1", "m2"]), f"WITH {_X}, l AS (SELECT user_id, cluster, 'm1' AS metric, m1 AS v FROM k UNION ALL SELECT user_id, cluster, 'm2', m2 FROM k), g AS (SELECT metric, count(DISTINCT v) AS dv FROM l WHERE v IS NOT NULL GROUP BY user_id, cluster, metric HAVING count(*) > 1) SELECT metric, count(*) FILTER (WHERE dv = 1) AS agree, count(*) FILTER (WHERE dv > 1) AS disagree FROM g GROUP BY metric")
add("agg20_disagreeing", lambda s, d: q.disagreeing(_clustered(s, d), ["user_id"], "m1", "event_id"), f"WITH {_X} SELECT user_id, event_id FROM k QUALIFY min(m1) OVER (PARTITION BY user_id, cluster) <> max(m1) OVER (PARTITION BY user_id, cluster)")
add(
    "agg17_gap_candidates",
    lambda s, d: q.gap_candidates(table(s, d, "events").select("user_id", "event_id", F.col("value").cast("decimal(18,4)").alias("c")), ["user_id"], "c", "event_id").select("user_id", "rows", "after_row", F.round(F.col("largest").cast("double"), 4).alias("largest"), F.round(F.col("median_other").cast("double"), 4).alias("median_other")),
    """WITH g AS (SELECT user_id, event_id, lead(c) OVER w - c AS gap, row_number() OVER w AS i FROM (SELECT *, value::DECIMAL(18,4) AS c FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY c, event_id)), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY gap DESC NULLS LAST, i) AS k FROM g),
p AS (SELECT user_id, count(*) AS rows, max(gap) AS largest, (min(i) FILTER (WHERE k = 1))::INT AS after_row, median(gap::DOUBLE) FILTER (WHERE k > 1) AS median_other FROM r GROUP BY 1) SELECT user_id, rows, after_row, round(largest::DOUBLE, 4) AS largest, round(median_other, 4) AS median_other FROM p WHERE rows >= 3 AND median_other > 0 AND largest::DOUBLE >= median_other * 2.5""",
)
add(
    "flt01_exact_keys",
    lambda s, d: table(s, d, "events").select("event_id", *(F.array_join(c, ",").alias(n) for n, c in zip(("missing", "extra"), v.key_differences(F.col("props"), ("k", "z")), strict=True))),
    "SELECT event_id, CASE WHEN list_contains(json_keys(props), 'k') THEN 'z' ELSE 'k,z' END AS missing, array_to_string(list_sort([x FOR x IN json_keys(props) IF x NOT IN ('k', 'z')]), ',') AS extra FROM events",
)


def _clean(s, d):
    k = F.col("vec_id")
    unit = lambda i, box: F.struct(F.lit(i).alias("id"), F.lit("cell").alias("type"), F.lit("t").alias("text"), box.alias("bbox_normalised"), F.lit("row").alias("role"))
    share = F.transform("a", lambda x: x / 1000.0)
    return boxes(s, d).select(
        "vec_id",
        F.lit("g").alias("group_id"),
        F.when(k % 5 != 0, "q").alias("question"),
        F.lit("p").alias("image_path"),
        F.struct(F.when(k % 7 != 0, "1").alias("raw"), F.when(k % 3 != 0, 1.0).alias("normalised_value")).alias("answer"),
        F.struct(F.when(k % 4 != 0, "u1").otherwise("u9").alias("target_id"), share.alias("bbox_normalised"), F.array(F.lit("u2")).alias("row_header_ids"), F.array(F.when(k % 6 != 0, "u1").otherwise("u8")).alias("column_header_ids"), F.array().cast("array<string>").alias("unit_ids")).alias("evidence"),
        F.array(unit("u1", share), unit("u2", share)).alias("evidence_units"),
        F.struct(F.array(F.when(k % 8 != 0, "x").otherwise("")).alias("allowed_types")).alias("counterfactual_policy"),
    )


_BOX = "a[3] > a[1] AND a[4] > a[2]"
_rules = [("blank_text", "vec_id % 5 = 0"), ("answer_raw", "vec_id % 7 = 0"), ("answer_number", "vec_id % 3 = 0"), ("unit_box", f"NOT ({_BOX})"), ("unknown_target", "vec_id % 4 = 0"), ("unknown_header", "vec_id % 6 = 0"), ("evidence_box", f"NOT ({_BOX})"), ("policy", "vec_id % 8 = 0")]
add("flt07_record_violations", lambda s, d: _clean(s, d).select("vec_id", F.array_join(v.record_violations(), ",").alias("violations")), f"WITH {BOXES_SQL} SELECT vec_id, concat_ws(',', {', '.join(f'CASE WHEN {c} THEN {chr(39)}{k}{chr(39)} END' for k, c in _rules)}) AS violations FROM boxes")
add(
    "flt08_grounding_reasons",
    lambda s, d: _clean(s, d).select("vec_id", F.struct("evidence", "evidence_units", "answer").alias("payload")).select("vec_id", v.grounding_reason().alias("reason")),
    f"WITH {BOXES_SQL} SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN 'unknown_target' WHEN vec_id % 6 = 0 THEN 'unknown_column_header' WHEN NOT ({_BOX}) THEN 'invalid_bbox' WHEN vec_id % 7 = 0 THEN 'missing_answer' END AS reason FROM boxes",
)


def _asked(s, d):
    k = F.col("o_orderkey")
    return table(s, d, "orders").select("o_orderkey", (k % 13 == 0).alias("req_comparison"), F.when(k % 7 == 0, F.array(F.lit("1"), F.lit("2"))).when(k % 5 == 0, F.array(F.lit("text"))).otherwise(F.array(F.lit("$ 1,200"))).alias("answer"), F.when(k % 3 == 0, "span").when(k % 3 == 1, "Arithmetic").alias("answer_type"), F.when(k % 2 == 0, "1200").when(k % 4 == 1, "600 + 600").otherwise("").alias("derivation"), F.array(F.lit("7")).alias("facts"))


add(
    "flt09_direct_questions",
    lambda s, d: v.question_reason(_asked(s, d)).select("o_orderkey", "reason"),
    "SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'comparison_required' WHEN o_orderkey % 7 = 0 THEN 'non_scalar_answer' WHEN o_orderkey % 5 = 0 THEN 'non_numeric_answer' WHEN o_orderkey % 3 = 2 THEN 'unsupported_answer_type_missing' WHEN o_orderkey % 3 = 0 THEN 'accepted' WHEN o_orderkey % 2 = 0 THEN 'accepted' WHEN o_orderkey % 4 = 1 THEN 'arithmetic_derivation' ELSE 'missing_direct_derivation' END AS reason FROM orders",
)
add(
    "flt17_first_invalid_variant",
    lambda s, d: v.first_invalid_variant(table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("group_id"), F.element_at(F.array(*map(F.lit, v.VARIANTS)), ((F.col("l_linenumber") - 1) % 4 + 1).cast("int")).alias("variant")).agg(F.max(F.when(F.col("l_discount") > 0.08, F.col("l_returnflag"))).alias("reason"))),
    "WITH r AS (SELECT l_orderkey AS group_id, (l_linenumber - 1) % 4 AS k, max(CASE WHEN l_discount > 0.08 THEN l_returnflag END) AS reason FROM lineitem GROUP BY 1, 2) SELECT group_id, arg_min(reason, k) FILTER (WHERE reason IS NOT NULL) AS reason FROM r GROUP BY 1",
)
add("join23_split_leaks", lambda s, d: v.split_leaks(table(s, d, "documents").select(F.md5("text").alias("key"), (F.col("doc_id") % 3).cast("string").alias("split"))).select("key", F.array_join("splits", ",").alias("splits")), "SELECT md5(text) AS key, string_agg(DISTINCT (doc_id % 3)::VARCHAR, ',' ORDER BY (doc_id % 3)::VARCHAR) AS splits FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id % 3) > 1")


def _custom(s, d):
    return table(s, d, "customer").select(F.col("c_custkey").alias("table_id"), (F.col("c_nationkey") < 3).alias("is_ood"))


_H = "h AS (SELECT c_custkey AS table_id, c_nationkey < 3 AS is_ood, row_number() OVER (PARTITION BY c_nationkey < 3 ORDER BY sha256('5:' || c_custkey), c_custkey) - 1 AS k FROM customer)"
add("smp02_assign_splits", lambda s, d: sm.assign_splits(_custom(s, d), 5, {"train": 300, "dev": 60, "test": 40}, "test"), f"WITH {_H} SELECT table_id, is_ood, CASE WHEN is_ood THEN CASE WHEN k < 40 THEN 'test' END WHEN k < 300 THEN 'train' WHEN k < 360 THEN 'dev' END AS assigned FROM h")


def _variants(s, d):
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("group_id"), F.element_at(F.array(*map(F.lit, v.VARIANTS)), ((F.col("l_linenumber") - 1) % 4 + 1).cast("int")).alias("variant")).distinct()


_VAR = f"v AS (SELECT DISTINCT l_orderkey AS group_id, {list(v.VARIANTS)}[(l_linenumber - 1) % 4 + 1] AS variant FROM lineitem)"
add("smp03_epoch_sample", lambda s, d: sm.epoch_sample(_variants(s, d), 3, 1), f"WITH {_VAR} SELECT group_id, variant FROM v QUALIFY row_number() OVER (PARTITION BY group_id, variant = 'clean' ORDER BY sha256('3:1:' || group_id || ':' || variant), variant) = 1")
_groups = lambda s, d: table(s, d, "customer").select(F.col("c_custkey").alias("group_id"))
_SCH = f"""p AS (SELECT g.c_custkey AS group_id, c.c AS cycle, list(k ORDER BY sha256('9:' || g.c_custkey || ':' || c.c || ':' || k)) AS kinds FROM customer g, (VALUES (0), (1)) c(c), (VALUES {', '.join(f"('{k}')" for k in COUNTERFACTUALS)}) t(k) GROUP BY 1, 2),
sch AS (SELECT (cycle * 3 + e.e)::INT AS epoch, sha256('9:place:' || (cycle * 3 + e.e) || ':' || group_id) AS place, group_id, cycle::INT AS cycle, kinds[e.e + 1] AS kind FROM p, (VALUES (0), (1), (2)) e(e))"""
add("smp06_cycle_schedule", lambda s, d: sm.schedule(_groups(s, d), 9, 2), f"WITH {_SCH} SELECT * FROM sch")
add(
    "smp07_matched_pairs",
    lambda s, d: sm.matched_pairs(table(s, d, "customer").select(F.col("c_custkey").alias("group_id"), F.col("c_name").alias("image_a")), table(s, d, "orders").select(F.col("o_custkey").alias("group_id"), F.col("o_orderkey").alias("image_b"), F.col("o_orderkey").alias("ordinal")).unionByName(table(s, d, "customer").select(F.col("c_custkey").alias("group_id"), F.lit(-1).cast("long").alias("image_b"), F.lit(-1).cast("long").alias("ordinal"))), 9, 2),
    f"WITH {_SCH} SELECT s.*, c.c_name AS image_a, b.image_b FROM sch s JOIN customer c ON s.group_id = c.c_custkey JOIN (SELECT c_custkey AS g, coalesce(max(o_orderkey), -1) AS image_b FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) b ON b.g = s.group_id",
)
add("win07_capped", lambda s, d: sm.capped(table(s, d, "orders").select(F.col("o_orderkey").alias("pair_id"), "o_custkey"), 4, "o_custkey", 3), "SELECT o_orderkey AS pair_id, o_custkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY sha256('4:' || o_orderkey), o_orderkey) <= 3")
add("smp10_audit_sample", lambda s, d: sm.sampled(table(s, d, "orders").select("o_orderkey", "o_custkey"), 8, 25, "o_orderkey"), "SELECT o_orderkey, o_custkey FROM orders ORDER BY sha256('8:' || o_orderkey), o_orderkey LIMIT 25")
add("smp11_dev_split", lambda s, d: sm.dev_split(table(s, d, "customer").select("c_custkey"), 6, 0.15, "c_custkey"), "SELECT c_custkey, row_number() OVER (ORDER BY sha256('6:' || c_custkey), c_custkey) <= round_even((SELECT count(*) FROM customer) * 0.15, 0) AS is_dev FROM customer")
add(
    "smp08_greedy_caps",
    lambda s, d: sm.greedy_caps(table(s, d, "orders").select(F.col("o_orderkey").alias("pair_id"), (F.col("o_custkey") % 40).alias("page"), (F.col("o_custkey") % 7).alias("company")), 2, {"page": 5, "company": 20}),
    """WITH o AS (SELECT o_orderkey AS k, (o_custkey % 40)::INT AS page, (o_custkey % 7)::INT AS company FROM orders),
rows AS (SELECT list(struct_pack(k := [k], page := [page], company := [company]) ORDER BY sha256('2:' || k), k) AS l FROM o),
taken AS (SELECT list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc.page, lambda p: p = x.page[1])) < 5 AND len(list_filter(acc.company, lambda c: c = x.company[1])) < 20
  THEN struct_pack(k := list_append(acc.k, x.k[1]), page := list_append(acc.page, x.page[1]), company := list_append(acc.company, x.company[1])) ELSE acc END,
  struct_pack(k := []::BIGINT[], page := []::INT[], company := []::INT[])) AS t FROM rows)
SELECT k AS pair_id, page::BIGINT AS page, company::BIGINT AS company FROM (SELECT unnest(t.k) AS k, unnest(t.page) AS page, unnest(t.company) AS company FROM taken)""",
)
add("smp15_jitter", lambda s, d: table(s, d, "customer").select("c_custkey", sm.jitter(7, F.col("c_custkey").cast("string"), [-2, 0, 1, 3]).alias("j")), "SELECT c_custkey, [-2, 1, 3][(('0x' || substr(sha256('7:' || c_custkey), 1, 16))::UBIGINT % 3)::INT + 1]::INT AS j FROM customer")


def _arms(s, d):
    o = outcomes(s, d)
    return o.select(F.concat("table_id", "document_id").alias("doc"), F.col("correct_a").cast("int").alias("ok")), o.select(F.concat("table_id", "document_id").alias("doc"), F.col("correct_b").cast("int").alias("ok"))


def _bootstrap(s, d):
    a, b = _arms(s, d)
    return r.bootstrap_delta(a, b, F.col("ok"), F.lit(1), "doc", 10_000, 3).select(*(F.round(c, 9).alias(c) for c in ("delta", "ci_low", "ci_high")), "replicates")


_pick = "(('0x' || substr(sha256('3:' || r || ':' || i), 1, 15))::UBIGINT % n)::BIGINT"
_ends = lambda lo, hi: f"list_sort(list(x))[least(floor({lo} * count(*))::INT, count(*) - 1) + 1] AS low, list_sort(list(x))[least(floor({hi} * count(*))::INT, count(*) - 1) + 1] AS high"
add(
    "smp12_bootstrap_delta",
    _bootstrap,
    f"""WITH {OUTCOMES_SQL}, c AS (SELECT row_number() OVER (ORDER BY doc) - 1 AS i, count(*) OVER () AS n, * FROM (SELECT table_id || document_id AS doc, sum(correct_a::INT) AS a, sum(correct_b::INT) AS b, count(*) AS k FROM outcomes GROUP BY 1)),
draws AS (SELECT r, {_pick} AS i FROM c, range(10000) t(r)), x AS (SELECT r, sum(b) / sum(k) - sum(a) / sum(k) AS x FROM draws JOIN c USING (i) GROUP BY 1), e AS (SELECT count(*)::INT AS replicates, {_ends(0.025, 0.975)} FROM x)
SELECT round((SELECT avg(correct_b::INT) - avg(correct_a::INT) FROM outcomes), 9) AS delta, round(low, 9) AS ci_low, round(high, 9) AS ci_high, replicates FROM e""",
)
add(
    "smp13_macro_bootstrap",
    lambda s, d: r.macro_bootstrap(outcomes(s, d).select("document_id", "table_id", F.col("correct_a").cast("int").alias("num"), F.lit(1).alias("den")), "document_id", 10_000, 3).select("replicates", F.round("ci_low", 9).alias("ci_low"), F.round("ci_high", 9).alias("ci_high")),
    f"""WITH {OUTCOMES_SQL}, p AS (SELECT document_id AS doc, table_id, sum(correct_a::INT) AS num, count(*) AS den FROM outcomes GROUP BY 1, 2), c AS (SELECT row_number() OVER (ORDER BY doc) - 1 AS i, count(*) OVER () AS n, doc FROM (SELECT DISTINCT doc FROM p)),
draws AS (SELECT DISTINCT r, {_pick} AS i FROM c, range(10000) t(r)), m AS (SELECT r, table_id, sum(num) / sum(den) AS m FROM draws JOIN c USING (i) JOIN p USING (doc) GROUP BY 1, 2), x AS (SELECT r, avg(m) AS x FROM m GROUP BY 1), e AS (SELECT count(*)::INT AS replicates, {_ends(0.025, 0.975)} FROM x)
SELECT replicates, round(low, 9) AS ci_low, round(high, 9) AS ci_high FROM e""",
)


def _null(s, d):
    o = outcomes(s, d).select(F.col("pair_id").alias("item"), "table_id", (F.col("n") % 53).alias("predicted"), (F.col("n") % 50).alias("value"))
    return r.permutation_null(o.drop("value"), o.select("table_id", "value").distinct(), 50, 1).select(*(F.round(c, 9).alias(c) for c in ("observed", "null_mean", "null_p05", "null_p95", "p")))


def _mixed(half, key):
    y = f"((({half} + {key}) * 1103515245 + 12345) % 2147483648)"
    return f"(((xor({y}, {y} >> 15) * 747796405) % 2147483648) >> 3)"


def _step(rows):
    """SQL of one walk step over rows(r, k, v, a, b, n, keys): v after the rounds of the keyed permutation."""
    sql = f"(SELECT *, v // b AS lo, v % b AS hi FROM {rows})"
    for i in range(1, r.ROUNDS + 1):
        new = f"(lo + {_mixed('hi', f'keys[{i}]')}) % a AS lo, hi" if i % 2 else f"lo, (hi + {_mixed('lo', f'keys[{i}]')}) % b AS hi"
        sql = f"(SELECT r, k, a, b, n, keys, {new} FROM {sql})"
    return f"SELECT r, k, lo * b + hi AS v, a, b, n, keys FROM {sql}"


_KEYS = ", ".join(f"('0x' || substr(sha256('1:' || r || ':{i}'), 1, 7))::BIGINT" for i in range(r.ROUNDS))
add(
    "smp14_permutation_null",
    _null,
    f"""WITH RECURSIVE {OUTCOMES_SQL}, o AS (SELECT pair_id AS item, table_id, n % 53 AS predicted, row_number() OVER (ORDER BY pair_id) - 1 AS k FROM outcomes), v AS (SELECT DISTINCT table_id, n % 50 AS predicted, 1 AS hit FROM outcomes), seen AS (SELECT count(hit) / count(*) AS observed FROM o LEFT JOIN v USING (table_id, predicted)),
sides AS (SELECT n, a, (n + a - 1) // a AS b FROM (SELECT count(*) AS n, floor(sqrt(count(*) - 1))::BIGINT + 1 AS a FROM o)),
start AS (SELECT r, k, k AS v, a, b, n, [{_KEYS}] AS keys FROM o, sides, range(50) t(r)),
walk AS ({_step('start')} UNION ALL {_step('(SELECT * FROM walk WHERE v >= n)')}),
x AS (SELECT w.r, count(hit) / count(*) AS x FROM walk w JOIN o ON o.k = w.k JOIN o t ON t.k = w.v LEFT JOIN v ON v.table_id = t.table_id AND v.predicted = o.predicted WHERE w.v < w.n GROUP BY 1),
e AS (SELECT avg(x) AS null_mean, {_ends(0.05, 0.95)}, (count(*) FILTER (WHERE x >= (SELECT observed FROM seen)) + 1)::DOUBLE / (count(*) + 1) AS p FROM x)
SELECT round((SELECT observed FROM seen), 9) AS observed, round(null_mean, 9) AS null_mean, round(low, 9) AS null_p05, round(high, 9) AS null_p95, round(p, 9) AS p FROM e""",
)
add("set01_union", lambda s, d: table(s, d, "customer").select(F.col("c_nationkey").alias("n"), F.lit("c").alias("kind")).unionByName(table(s, d, "supplier").select(F.lit("s").alias("kind"), F.col("s_nationkey").alias("n"))).groupBy("kind", "n").agg(F.count("*").alias("k")), "SELECT 'c' AS kind, c_nationkey AS n, count(*) AS k FROM customer GROUP BY 2 UNION ALL SELECT 's', s_nationkey, count(*) FROM supplier GROUP BY 2")
add("set02_intersect", lambda s, d: table(s, d, "customer").select(F.col("c_nationkey").alias("n")).intersect(table(s, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("n"))), "SELECT c_nationkey AS n FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
add("set03_except", lambda s, d: table(s, d, "customer").select(F.col("c_nationkey").alias("n")).subtract(table(s, d, "supplier").where("s_acctbal > 8000").select(F.col("s_nationkey").alias("n"))), "SELECT c_nationkey AS n FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000")
add("set04_unordered_pairs", lambda s, d: table(s, d, "orders").select(F.array_sort(F.array(F.col("o_custkey") % 30, F.col("o_orderkey") % 30)).alias("p")).distinct().select(F.col("p")[0].alias("a"), F.col("p")[1].alias("b")), "SELECT DISTINCT least(o_custkey % 30, o_orderkey % 30) AS a, greatest(o_custkey % 30, o_orderkey % 30) AS b FROM orders")
add("udf04_windowed_events", lambda s, d: visits.windowed(table(s, d, "events"), width="1 hour").select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("w"), "event_type", "n", F.round("total", 4).alias("total")), "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS w, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
