"""Queries over facts, grids, questions and instances."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import is_numeric
from ..operators import pairs as p
from ..operators import tables as t
from .carriers import FACTS_SQL, GRID_SQL, facts, grid, table

QUERIES, SQL = {}, {}


def add(name, query, sql):
    QUERIES[name], SQL[name] = query, sql


_ONE = "one AS (SELECT table_id, metric, period, unit, min(value) AS value FROM facts GROUP BY ALL HAVING min(value) = max(value))"
_PP = f"""{FACTS_SQL}, {_ONE}, pp AS (SELECT a.table_id, a.metric, a.unit, a.period AS period_a, b.period AS period_b, a.value AS value_a, b.value AS value_b, abs(a.period::INT - b.period::INT) AS gap
  FROM one a JOIN one b USING (table_id, metric, unit) WHERE a.period < b.period AND a.value <> b.value)"""
add("join15_period_pairs", lambda s, d: p.period_pairs(facts(s, d), caps=False), f"WITH {_PP} SELECT *, CASE WHEN gap = 1 THEN 'adjacent' ELSE 'skip' END AS rule FROM pp")
add(
    "win02_capped_period_pairs",
    lambda s, d: p.period_pairs(facts(s, d)),
    f"WITH {_PP}, k AS (SELECT * FROM pp QUALIFY row_number() OVER (PARTITION BY table_id, metric ORDER BY gap, period_a, period_b, unit) <= 4) SELECT *, CASE WHEN gap = 1 THEN 'adjacent' ELSE 'skip' END AS rule FROM k QUALIFY row_number() OVER (PARTITION BY table_id ORDER BY gap, metric, period_a, period_b, unit) <= 24",
)
add("win01_agreed_facts", lambda s, d: p.agreed(facts(s, d), ["table_id", "metric", "period", "unit"], "value", "arrival").select("table_id", "metric", "period", "unit", "value"), f"WITH {FACTS_SQL}, {_ONE} SELECT * FROM one")
_JW = lambda c: f"list_distinct([x FOR x IN string_split({c}, ' ') IF length(x) > 1 AND NOT list_contains(['of', 'the', 'and', 'in', 'for', 'to', 'a', 'an'], x)])"
_JAC = f"len(list_intersect({_JW('a.metric')}, {_JW('b.metric')}))::DOUBLE / len(list_distinct(list_concat({_JW('a.metric')}, {_JW('b.metric')})))"
add(
    "join16_metric_pairs",
    lambda s, d: p.metric_pairs(facts(s, d)).drop("confusable").withColumn("jaccard", F.round("jaccard", 6)),
    f"""WITH {FACTS_SQL}, one AS (SELECT table_id, metric, period, unit, scope, min(value) AS value FROM facts GROUP BY ALL HAVING min(value) = max(value))
SELECT a.table_id, a.period, a.unit, a.metric AS metric_a, b.metric AS metric_b, a.value AS value_a, b.value AS value_b, round({_JAC}, 6) AS jaccard, 'metric' AS pair_type
FROM one a JOIN one b ON a.table_id = b.table_id AND a.period = b.period AND a.unit = b.unit AND a.scope IS NOT DISTINCT FROM b.scope
WHERE a.metric < b.metric AND a.value <> b.value AND {_JAC} >= 0.5 AND NOT (regexp_replace(a.metric, '\\s*\\(?\\d\\)?$', '') = regexp_replace(b.metric, '\\s*\\(?\\d\\)?$', ''))""",
)


def _questions(s, d):
    o = table(s, d, "orders")
    k = F.col("o_orderkey")
    return o.select(F.col("o_custkey").alias("table_id"), k.alias("question"), F.when(k % 7 != 0, F.when(k % 2 == 0, "adjusted ebitda").when(k % 3 == 0, "ebitda").otherwise("revenue")).alias("metric"), F.when(k % 11 != 0, F.year("o_orderdate").cast("string")).alias("period"), (k % 5).cast("string").alias("answer"), F.when(k % 3 == 0, "thousand").otherwise("million").alias("scale"))


_Q = """q AS (SELECT o_custkey AS table_id, o_orderkey AS question, CASE WHEN o_orderkey % 7 <> 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'adjusted ebitda' WHEN o_orderkey % 3 = 0 THEN 'ebitda' ELSE 'revenue' END END AS metric,
  CASE WHEN o_orderkey % 11 <> 0 THEN year(o_orderdate)::VARCHAR END AS period, (o_orderkey % 5)::VARCHAR AS answer, CASE WHEN o_orderkey % 3 = 0 THEN 'thousand' ELSE 'million' END AS scale FROM orders)"""
add(
    "join14_question_pairs",
    lambda s, d: p.question_pairs(_questions(s, d)),
    f"""WITH {_Q} SELECT a.table_id, a.question AS question_a, b.question AS question_b, CASE WHEN a.answer = b.answer THEN 'rejected_gold_answers_identical'
  WHEN a.metric <> b.metric AND replace(a.metric, 'adjusted ', '') = replace(b.metric, 'adjusted ', '') AND (a.period = b.period OR a.period IS NULL AND b.period IS NULL) THEN 'basis'
  WHEN a.metric = b.metric AND a.period <> b.period THEN 'period' WHEN a.metric <> b.metric AND a.period = b.period THEN 'metric'
  WHEN a.metric = b.metric AND a.period = b.period AND a.scale <> b.scale THEN 'unit' WHEN a.metric IS NULL OR b.metric IS NULL THEN 'rejected_metric_ambiguous'
  WHEN a.period IS NULL OR b.period IS NULL THEN 'rejected_period_ambiguous' WHEN a.metric <> b.metric AND a.period <> b.period THEN 'rejected_more_than_one_dimension_changed' ELSE 'rejected_no_matching_rule' END AS verdict
FROM q a JOIN q b ON a.table_id = b.table_id AND a.question < b.question""",
)


def _instances(s, d):
    k = F.col("o_orderkey")
    label = F.element_at(F.array(*map(F.lit, ("FY", "Actual", "Budget", "LTM", "Forecast", "12M Budget", "Current", "Q3"))), (k % 8 + 1).cast("int"))
    return table(s, d, "orders").select((F.col("o_custkey") % 100).alias("document_id"), F.col("o_custkey").alias("company"), k.alias("ordinal"), label.alias("period"), F.substring(F.year("o_orderdate").cast("string"), F.when(k % 2 == 0, 1).otherwise(3), F.lit(4)).alias("year"), F.month("o_orderdate").cast("string").alias("month"), F.when(k % 3 != 0, (k % 90).cast("double")).alias("column_x"))


_I = """i AS (SELECT o_custkey % 100 AS document_id, o_custkey AS company, o_orderkey AS ordinal, ['FY', 'Actual', 'Budget', 'LTM', 'Forecast', '12M Budget', 'Current', 'Q3'][(o_orderkey % 8 + 1)::INT] AS period,
  CASE WHEN o_orderkey % 2 = 0 THEN year(o_orderdate) ELSE 2000 + year(o_orderdate) % 100 END AS y, month(o_orderdate) AS m, CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 90)::DOUBLE END AS x FROM orders)"""
add(
    "join17_instance_pairs",
    lambda s, d: p.instance_pairs(_instances(s, d)),
    f"""WITH {_I} SELECT a.document_id, a.company, a.ordinal AS ordinal_a, b.ordinal AS ordinal_b, CASE WHEN a.y = b.y AND (a.period = 'Actual' AND b.period = 'Forecast' OR a.period = 'Forecast' AND b.period = 'Actual') THEN 'basis'
  WHEN a.period NOT IN ('FY', 'LTM', 'Q3') OR b.period NOT IN ('FY', 'LTM', 'Q3') THEN 'excluded'
  WHEN a.y = b.y AND a.m = b.m AND a.period = b.period AND NOT coalesce(abs(a.x - b.x) > 20, false) THEN 'identical' ELSE 'period' END AS verdict
FROM i a JOIN i b ON a.document_id = b.document_id AND a.company = b.company AND a.ordinal < b.ordinal""",
)


def _records(s, d):
    k = F.col("o_orderkey")
    return table(s, d, "orders").select(F.floor(k / 3).alias("pair_id"), (F.col("o_custkey") % 9).alias("document_a"), F.when(k % 13 == 0, 1).otherwise(F.col("o_custkey") % 9).alias("table_a"), (k % 101).alias("question_a"), (F.col("o_custkey") % 101).alias("question_b"), (k % 5).alias("answer_a"), (F.col("o_custkey") % 5).alias("answer_b"), F.when(k % 17 != 0, k).alias("evidence_a"), k.alias("evidence_b"), F.when(k % 19 == 0, "other").otherwise("period").alias("pair_type"))


add(
    "flt19_pair_checks",
    lambda s, d: p.pair_checks(_records(s, d)),
    """WITH r AS (SELECT o_orderkey // 3 AS pair_id, o_orderkey % 101 AS qa, o_custkey % 101 AS qb, * FROM orders), f AS (SELECT *, count(*) OVER (PARTITION BY pair_id) > 1 AS dup, count(*) OVER (PARTITION BY least(qa, qb), greatest(qa, qb)) > 1 AS rev FROM r)
SELECT k AS rule, v::BIGINT AS violations FROM (SELECT count(*) FILTER (WHERE dup) AS duplicate_id, count(*) FILTER (WHERE qa = qb) AS self_pair, count(*) FILTER (WHERE rev) AS reversed_duplicate, count(*) FILTER (WHERE o_orderkey % 5 = o_custkey % 5) AS identical_answers,
  count(*) FILTER (WHERE o_orderkey % 13 = 0 AND o_custkey % 9 <> 1) AS document_not_table, count(*) FILTER (WHERE o_orderkey % 17 = 0) AS missing_evidence, count(*) FILTER (WHERE o_orderkey % 19 = 0) AS bad_type FROM f) UNPIVOT (v FOR k IN (duplicate_id, self_pair, reversed_duplicate, identical_answers, document_not_table, missing_evidence, bad_type))""",
)
add(
    "win06_sequential_ids",
    lambda s, d: p.numbered(table(s, d, "customer").select("c_mktsegment", "c_custkey"), "pair", ["c_mktsegment", "c_custkey"]),
    "SELECT c_mktsegment, c_custkey, format('pair_{:06d}', row_number() OVER (ORDER BY c_mktsegment, c_custkey) - 1) AS pair_id FROM customer",
)


def _capped_pairs(s, d):
    pairs = p.period_pairs(facts(s, d), caps=False)
    return pairs.select(F.concat_ws("|", F.col("table_id").cast("string"), "metric", "unit", "period_a", "period_b").alias("pair_id"), "table_id", "metric", "rule")


_h = lambda stage: f"sha256('7:{stage}:' || pair_id)"
add(
    "smp09_primary_selection",
    lambda s, d: p.primary_selection(_capped_pairs(s, d), 7, 5, 60, 20),
    f"""WITH {_PP}, c AS (SELECT concat_ws('|', table_id, metric, unit, period_a, period_b) AS pair_id, table_id, metric, CASE WHEN gap = 1 THEN 'adjacent' ELSE 'skip' END AS rule FROM pp),
m AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY table_id, metric, rule ORDER BY {_h('metric')}, pair_id) <= 1),
t AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY table_id ORDER BY {_h('table')}, pair_id) <= 5)
SELECT pair_id, table_id, metric, rule FROM t QUALIFY row_number() OVER (PARTITION BY rule ORDER BY {_h('all')}, pair_id) <= CASE rule WHEN 'adjacent' THEN 60 ELSE 20 END""",
)

_NUM = lambda c: f"regexp_matches({c}, '^\\(?-?[$£€]?\\s*\\d[\\d,]*(\\.\\d+)?%?\\)?$')"
_YEAR = lambda c: f"regexp_matches({c}, '\\b(19|20)\\d{{2}}\\b')"
add(
    "join09_header_context",
    lambda s, d: t.with_headers(grid(s, d)).where((F.col("text") != "") & is_numeric(F.col("text"))).select("table_id", "row_idx", "col_idx", *(F.array_join(F.transform(c, lambda x: x.text), "|").alias(c) for c in ("row_headers", "column_headers", "unit_cells", "spanning_headers"))),
    f"""WITH {GRID_SQL} SELECT c.table_id, c.row_idx, c.col_idx,
  coalesce((SELECT string_agg(x.text, '|' ORDER BY x.col_idx) FROM grid x WHERE x.table_id = c.table_id AND x.row_idx = c.row_idx AND x.col_idx < c.col_idx AND x.text <> '' AND NOT {_NUM('x.text')}), '') AS row_headers,
  coalesce((SELECT string_agg(x.text, '|' ORDER BY x.row_idx) FROM grid x WHERE x.table_id = c.table_id AND x.col_idx = c.col_idx AND x.row_idx < c.row_idx AND x.text <> '' AND {_YEAR('x.text')}), '') AS column_headers,
  coalesce((SELECT string_agg(x.text, '|' ORDER BY x.row_idx) FROM grid x WHERE x.table_id = c.table_id AND x.col_idx = c.col_idx AND x.row_idx < c.row_idx AND x.text <> '' AND NOT {_YEAR('x.text')} AND x.text = 'In thousands'), '') AS unit_cells,
  coalesce((SELECT string_agg(x.text, '|' ORDER BY x.row_idx) FROM grid x WHERE x.table_id = c.table_id AND x.col_idx = c.col_idx AND x.row_idx < c.row_idx AND x.text <> '' AND NOT {_YEAR('x.text')} AND x.text <> 'In thousands'), '') AS spanning_headers
FROM grid c WHERE c.text <> '' AND {_NUM('c.text')}""",
)
add(
    "win03_column_scopes",
    lambda s, d: t.column_scopes(grid(s, d)),
    f"WITH {GRID_SQL} SELECT DISTINCT table_id, col_idx, text AS scope FROM grid WHERE row_idx = 0 AND text <> ''",
)
_FACT = f"""{GRID_SQL}, gf AS (SELECT c.table_id, c.row_idx, c.col_idx, c.text AS value,
  CASE WHEN c.text LIKE '(%' THEN '-' || replace(replace(c.text, '(', ''), ')', '') ELSE c.text END AS value_norm, 'metric ' || c.row_idx AS metric, (2015 + c.col_idx)::VARCHAR AS period, CASE WHEN c.col_idx <= 2 THEN 'Years ended' ELSE 'In thousands' END AS scope,
  CASE WHEN c.row_idx = 8 THEN 'bare_total_row' ELSE 'accepted' END AS reason FROM grid c WHERE c.row_idx > 1 AND c.col_idx > 0)"""
add(
    "flt10_grid_facts",
    lambda s, d: t.facts(grid(s, d)).where("reason = 'accepted'"),
    f"WITH {_FACT} SELECT *, CASE WHEN col_idx > 2 THEN 'in thousands' ELSE 'unscaled' END AS unit FROM gf WHERE reason = 'accepted'",
)
add("agg25_fact_funnel", lambda s, d: t.facts(grid(s, d)).groupBy("reason").agg(F.count("*").alias("n")), f"WITH {_FACT} SELECT CASE WHEN r.x = 'header' THEN 'no_metric_or_degenerate' ELSE r.x END AS reason, count(*) AS n FROM (SELECT reason AS x FROM gf UNION ALL SELECT 'header' FROM grid WHERE row_idx = 1 AND col_idx > 0) r GROUP BY 1")


def _asked(s, d):
    g = grid(s, d)
    return g, g.where("row_idx > 1 and col_idx > 0").select("table_id", (F.col("row_idx") * 10 + F.col("col_idx")).alias("question"), F.col("text").alias("answer"))


_AQ = f"""{GRID_SQL}, body AS (SELECT *, CASE WHEN text LIKE '(%' THEN '-' || replace(replace(text, '(', ''), ')', '') ELSE text END AS k FROM grid WHERE text <> ''), q AS (SELECT table_id, row_idx * 10 + col_idx AS question, k FROM body WHERE row_idx > 1 AND col_idx > 0),
ans AS (SELECT q.table_id, q.question, min(b.row_idx) AS row_idx, min(b.col_idx) AS col_idx, min(b.text) AS text, q.k FROM q JOIN body b ON q.table_id = b.table_id AND q.k = b.k GROUP BY q.table_id, q.question, q.k HAVING count(*) = 1)"""
add("join12_answer_cells", lambda s, d: (lambda g, q: t.answer_cells(q, g))(*_asked(s, d)), f"WITH {_AQ} SELECT table_id, question, row_idx, col_idx, text FROM ans")
add(
    "join10_header_swaps",
    lambda s, d: (lambda g, q: t.header_swaps(t.answer_cells(q, g), g))(*_asked(s, d)),
    f"""WITH {_AQ} SELECT a.table_id, a.question, (2015 + a.col_idx)::VARCHAR AS header, min(b.col_idx) AS peer_col, (2015 + min(b.col_idx))::VARCHAR AS peer_header, arg_min(b.text, b.col_idx) AS peer_value
FROM ans a JOIN body b ON a.table_id = b.table_id AND a.row_idx = b.row_idx AND b.col_idx > 0 AND b.col_idx <> a.col_idx AND b.k <> a.k GROUP BY a.table_id, a.question, a.col_idx""",
)
add(
    "join11_irrelevant_cells",
    lambda s, d: (lambda g, q: t.irrelevant_cells(t.answer_cells(q, g), g, t.answer_cells(q, g).select("table_id", "question", (F.col("row_idx") + 1).alias("row_idx"), "col_idx")))(*_asked(s, d)),
    f"""WITH {_AQ} SELECT a.table_id, a.question, c.distance, c.row_idx, c.col_idx, c.text FROM ans a, LATERAL (SELECT abs(b.row_idx - a.row_idx) + abs(b.col_idx - a.col_idx) AS distance, b.row_idx, b.col_idx, b.text FROM body b
  WHERE b.table_id = a.table_id AND b.row_idx > 1 AND b.col_idx > 0 AND b.row_idx <> a.row_idx AND b.k <> a.k AND NOT (b.row_idx = a.row_idx + 1 AND b.col_idx = a.col_idx) ORDER BY 1, 2, 3 LIMIT 1) c""",
)
add(
    "prj18_overlay",
    lambda s, d: t.overlay(grid(s, d), grid(s, d).where("row_idx = 3 and col_idx = 2").select("table_id", "row_idx", "col_idx", F.lit("7").alias("new_text"))).select("table_id", "row_idx", "col_idx", "text", t.cell_id(F.col("row_idx"), F.col("col_idx")).alias("cell_id")),
    f"WITH {GRID_SQL} SELECT table_id, row_idx, col_idx, CASE WHEN row_idx = 3 AND col_idx = 2 THEN '7' ELSE text END AS text, format('r{{:02d}}c{{:02d}}', row_idx, col_idx) AS cell_id FROM grid",
)
add(
    "src08_flatten_grid",
    lambda s, d: t.flatten_grid(table(s, d, "nation").groupBy(F.col("n_regionkey").alias("table_id")).agg(F.array_sort(F.collect_list(F.array(F.col("n_name"), F.when(F.col("n_nationkey") % 2 == 0, F.lit(" x "))))).alias("rows"))),
    "WITH r AS (SELECT n_regionkey AS table_id, n_name, n_nationkey, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1)::INT AS row_idx FROM nation) SELECT table_id, row_idx, 0::INT AS col_idx, n_name AS text FROM r UNION ALL SELECT table_id, row_idx, 1, CASE WHEN n_nationkey % 2 = 0 THEN 'x' ELSE '' END FROM r",
)
add(
    "join08_context_blocks",
    lambda s, d: t.context_blocks(table(s, d, "conversations").select(F.col("conv_id").alias("page"), F.col("turn").alias("ord"), F.col("text")), 2),
    "SELECT conv_id AS page, turn AS ord, text, (SELECT string_agg(x.text, ' ' ORDER BY x.turn) FROM conversations x WHERE x.conv_id = c.conv_id AND abs(x.turn - c.turn) <= 2) AS context, (SELECT count(*) FROM conversations x WHERE x.conv_id = c.conv_id AND abs(x.turn - c.turn) <= 2)::INT AS n_context FROM conversations c",
)
add(
    "prj06_ordered_units",
    lambda s, d: t.ordered_units(table(s, d, "lineitem").select(F.col("l_orderkey").alias("group_id"), (F.col("l_partkey") % 7).alias("id"), F.col("l_linenumber").alias("role_rank"), F.concat(F.lit("role"), F.col("l_linenumber").cast("string")).alias("role"))).select("group_id", F.array_join(F.transform("units", lambda u: F.concat(u.id.cast("string"), F.lit(":"), u.role)), ",").alias("units")),
    "WITH o AS (SELECT l_orderkey AS group_id, l_partkey % 7 AS id, min(l_linenumber) AS k FROM lineitem GROUP BY 1, 2) SELECT group_id, string_agg(id || ':role' || k, ',' ORDER BY k, id) AS units FROM o GROUP BY 1",
)
add(
    "join22_value_membership",
    lambda s, d: facts(s, d).groupBy("table_id").agg(F.collect_set(F.col("value") % 40).alias("v"), F.max("value").alias("mx")).select("table_id", F.array_contains("v", F.col("mx") % 37).alias("is_member"), F.size("v").alias("n_values")),
    f"WITH {FACTS_SQL}, v AS (SELECT table_id, list(DISTINCT value % 40) AS v, max(value) AS mx FROM facts GROUP BY 1) SELECT table_id, list_contains(v, mx % 37) AS is_member, len(v)::INT AS n_values FROM v",
)
