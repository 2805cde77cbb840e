"""Queries over record builders and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import question_key
from ..operators import records as r
from ..operators import tables as t
from ..sources import readers, sinks
from .carriers import table
from .mining import _AQ, _asked

QUERIES, SQL = {}, {}


def add(name, query, sql):
    QUERIES[name], SQL[name] = query, sql


def _orders(s, d):
    return table(s, d, "orders")


add(
    "prj01_metric_and_period",
    lambda s, d: _orders(s, d).select("o_orderkey", r.metric_and_period(F.filter(F.array(F.lit("Revenue"), F.col("o_orderpriority")), lambda x, i: (i == 0) | (F.col("o_orderkey") % 2 == 0)), F.array(F.lit("Notes"), F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy")).otherwise("x"), F.lit("Total"))).alias("m")).select("o_orderkey", "m.*"),
    "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE 'Revenue' END AS metric, CASE WHEN o_orderkey % 3 = 0 THEN year(o_orderdate)::VARCHAR ELSE 'Total' END AS period FROM orders",
)
add(
    "prj04_clean_records",
    lambda s, d: r.clean_records(_orders(s, d).select(F.concat(F.lit("doc "), F.col("o_custkey").cast("string")).alias("document"), F.concat(F.lit("Q/"), F.col("o_orderkey").cast("string")).alias("question"), F.concat(F.lit("($ "), F.lit("12"), F.lit(")")).alias("answer"), F.array(F.lit("m")).alias("row_headers"), F.array(F.lit("2019")).alias("column_headers"), F.lit("i.png").alias("image_path")), "orders").select("group_id", "evidence_id", "answer.normalised_value", "answer.metric", "answer.period"),
    "SELECT 'orders_doc_' || o_custkey || '_Q_' || o_orderkey AS group_id, 'field_' || substr(sha256('doc ' || o_custkey || '|Q/' || o_orderkey), 1, 16) AS evidence_id, -12.0::DOUBLE AS normalised_value, 'm' AS metric, '2019' AS period FROM orders",
)


def _variants(s, d):
    return table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("group_id"), F.concat(F.lit("v"), F.col("l_linenumber").cast("string")).alias("variant")).agg(F.max("l_partkey").alias("part"))


add(
    "prj09_nest_and_flatten",
    lambda s, d: r.flatten_variants(r.nest_variants(_variants(s, d), []), ["v1", "v3"]),
    "SELECT l_orderkey AS group_id, 'v' || l_linenumber AS variant, max(l_partkey) AS part FROM lineitem WHERE l_linenumber IN (1, 3) GROUP BY 1, 2",
)
add(
    "prj12_prediction_rows",
    lambda s, d: r.prediction_rows(_orders(s, d).select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, "Answer: '1,200'").when(F.col("o_orderkey") % 4 == 1, "$ 1200").when(F.col("o_orderkey") % 4 == 2, "7").alias("prediction"), F.lit("1,200").alias("target"), F.when(F.col("o_orderkey") % 5 == 0, "boom").alias("error"))).select("o_orderkey", "exact_correct", "numeric_correct"),
    "SELECT o_orderkey, o_orderkey % 4 = 0 AND o_orderkey % 5 <> 0 AS exact_correct, o_orderkey % 4 < 2 AND o_orderkey % 5 <> 0 AS numeric_correct FROM orders",
)


def _pairs(s, d):
    c = table(s, d, "customer")
    return c.select(F.col("c_custkey").alias("pair_id"), F.col("c_nationkey").alias("table_id"), F.col("c_mktsegment").alias("document_id"), F.concat(F.lit("q"), (F.col("c_custkey") % 40).cast("string")).alias("question_a"), F.concat(F.lit("q"), (F.col("c_custkey") % 50).cast("string")).alias("question_b"), (F.col("c_custkey") % 40).cast("string").alias("answer_a"), (F.col("c_custkey") % 50).cast("string").alias("answer_b"))


def _predicted(s, d):
    segments = table(s, d, "customer").select("c_mktsegment").distinct()
    base = segments.select(F.col("c_mktsegment").alias("doc"), F.explode(F.sequence(F.lit(0), F.lit(44))).alias("q"))
    return base.select(F.lit("base").alias("label"), question_key(F.col("doc"), F.concat(F.lit("q"), F.col("q").cast("string")), F.lit(None).cast("string")).alias("question_key"), (F.col("q") - F.col("q") % 3).cast("string").alias("prediction"))


add(
    "join02_pair_outcomes",
    lambda s, d: r.pair_outcomes(_pairs(s, d), _predicted(s, d)),
    "WITH p AS (SELECT c_custkey AS pair_id, c_nationkey AS table_id, c_mktsegment AS document_id, c_custkey % 40 AS a, c_custkey % 50 AS b FROM customer WHERE c_custkey % 50 < 45) SELECT 'base' AS label, pair_id, table_id, document_id, a % 3 = 0 AS correct_a, b % 3 = 0 AS correct_b, a - a % 3 = b AS a_captured, b - b % 3 = a AS b_captured, a - a % 3 = b - b % 3 AS collapsed FROM p",
)
add(
    "join20_image_sources",
    lambda s, d: r.resolve_images(table(s, d, "nation").select(F.col("n_nationkey").alias("table_id")), table(s, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("table_id"), F.col("n_name").alias("path")), table(s, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("table_id"), F.lower("n_name").alias("path"))),
    "SELECT n_nationkey AS table_id, CASE WHEN n_regionkey = 1 THEN n_name WHEN n_regionkey < 3 THEN lower(n_name) END AS path, CASE WHEN n_regionkey = 1 THEN 'existing' WHEN n_regionkey < 3 THEN 'fresh' ELSE 'missing' END AS image_source FROM nation",
)
add(
    "join21_replay",
    # every seventh group names a table that no source row has
    lambda s, d: r.replay(_orders(s, d).select(F.concat_ws("_", F.lit("syn"), (F.col("o_custkey") + F.when(F.col("o_orderkey") % 7 == 0, 100_000_000).otherwise(0)).cast("string"), F.col("o_orderkey").cast("string")).alias("group_id"), F.col("o_orderpriority").alias("question")), _orders(s, d).select(F.col("o_custkey").alias("source_index"), F.col("o_orderpriority").alias("question"), F.col("o_orderkey").alias("ordinal"), F.col("o_orderkey").alias("row_id"))).select("group_id", "question", "source_index", F.coalesce("row_id", F.lit(-1)).alias("row_id"), "mismatch"),
    "WITH s AS (SELECT o_custkey AS source_index, o_orderpriority AS question, max(o_orderkey) AS row_id FROM orders GROUP BY 1, 2), g AS (SELECT o_custkey + CASE WHEN o_orderkey % 7 = 0 THEN 100000000 ELSE 0 END AS source_index, o_orderkey, o_orderpriority AS question FROM orders) SELECT 'syn_' || source_index || '_' || o_orderkey AS group_id, question, source_index, coalesce(row_id, -1) AS row_id, row_id IS NULL AS mismatch FROM g LEFT JOIN s USING (source_index, question)",
)
add(
    "join19_candidates",
    lambda s, d: r.candidates(table(s, d, "customer").select(F.col("c_nationkey").alias("document_id"), F.col("c_custkey").alias("instance"), F.create_map(F.lit("balance"), F.col("c_acctbal").cast("decimal(12,2)").cast("string"), F.lit("blank"), F.lit(" "), F.lit("segment"), F.col("c_mktsegment")).alias("values")), table(s, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_nationkey").alias("document_id"), F.col("c_custkey").alias("instance")), table(s, d, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("document_id"))),
    "WITH k AS (SELECT c.* FROM customer c JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2 AND c_custkey % 3 <> 0) SELECT c_nationkey AS document_id, c_custkey AS instance, 'balance' AS metric, c_acctbal::DECIMAL(12,2)::VARCHAR AS value FROM k UNION ALL SELECT c_nationkey, c_custkey, 'segment', c_mktsegment FROM k",
)
add(
    "smp16_counterfactual_plans",
    lambda s, d: (lambda g, q: (lambda a: r.counterfactual_plans(a, t.header_swaps(a, g), t.irrelevant_cells(a, g, a.select("table_id", "question", "row_idx", "col_idx")), F.lit("99")))(t.answer_cells(q, g)))(*_asked(s, d)).select("table_id", "question", "variant", "row_idx", "col_idx", "new_text"),
    f"""WITH {_AQ}, swap AS (SELECT a.table_id, a.question, arg_min(b.text, b.col_idx) AS peer FROM ans a JOIN body b ON a.table_id = b.table_id AND a.row_idx = b.row_idx AND b.col_idx > 0 AND b.col_idx <> a.col_idx AND b.k <> a.k GROUP BY 1, 2),
other AS (SELECT a.table_id, a.question, c.* FROM ans a, LATERAL (SELECT b.row_idx AS ir, b.col_idx AS ic, b.text AS it FROM body b WHERE b.table_id = a.table_id AND b.row_idx > 1 AND b.col_idx > 0 AND b.row_idx <> a.row_idx AND b.k <> a.k ORDER BY abs(b.row_idx - a.row_idx) + abs(b.col_idx - a.col_idx), b.row_idx, b.col_idx LIMIT 1) c),
j AS (SELECT * FROM ans JOIN swap USING (table_id, question) JOIN other USING (table_id, question))
SELECT table_id, question, 'clean' AS variant, NULL::INT AS row_idx, NULL::INT AS col_idx, NULL::VARCHAR AS new_text FROM j UNION ALL SELECT table_id, question, 'target_value', row_idx, col_idx, '99' FROM j
UNION ALL SELECT table_id, question, 'header_address_swap', row_idx, col_idx, peer FROM j UNION ALL SELECT table_id, question, 'irrelevant_value', ir, ic, it || '1' FROM j""",
)
add("prj16_prompts", lambda s, d: table(s, d, "part").select("p_partkey", r.qa_prompt(F.col("p_name")).alias("a"), F.size(r.messages(r.grounding_prompt(F.col("p_name")), F.lit("i"))[0].parts).alias("parts")), "SELECT p_partkey, 'Answer the question from the table image.' || chr(10) || chr(10) || 'Question: ' || p_name || chr(10) || 'Answer:' AS a, 2::INT AS parts FROM part")
add(
    "src03_index_by",
    lambda s, d: readers.index_by(_orders(s, d).select(F.when(F.col("o_orderkey") % 9 != 0, F.col("o_custkey").cast("string")).otherwise(" ").alias("uid"), "o_orderkey", "o_orderpriority"), "uid", "o_orderkey"),
    "SELECT o_custkey::VARCHAR AS uid, max(o_orderkey) AS o_orderkey, arg_max(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders WHERE o_orderkey % 9 <> 0 GROUP BY 1",
)
add(
    "src04_qa_records",
    lambda s, d: readers.qa_records(table(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.length("text").alias("n")))).alias("questions"))),
    "SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1)::INT AS question_no, turn, role, length(text)::INT AS n FROM conversations",
)
add(
    "src10_excluded_keys",
    lambda s, d: readers.excluded_keys(table(s, d, "customer").select(F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("source_table_id"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_nationkey")).alias("source_index"))),
    "SELECT DISTINCT 'id:' || c_mktsegment AS key FROM customer WHERE c_custkey % 2 = 0 UNION SELECT DISTINCT 'index:' || c_nationkey FROM customer WHERE c_custkey % 3 = 0",
)
add(
    "src12_field_instances",
    lambda s, d: readers.field_instances(table(s, d, "customer").select(F.col("c_nationkey").alias("document_id"), F.lit("1").alias("page_id"), F.when(F.col("c_custkey") % 2 == 0, "company").otherwise("other").alias("group"), F.col("c_custkey").alias("instance_index"), F.create_map(F.lit("name"), F.when(F.col("c_custkey") % 3 == 0, F.lit("  ")).otherwise(F.col("c_name")), F.lit("segment"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment"))).alias("values"), F.create_map(F.lit("name"), F.struct(F.lit(1).alias("top"))).alias("boxes")), "company").select("document_id", "instance_index", F.size("values").alias("n")),
    "SELECT c_nationkey AS document_id, c_custkey AS instance_index, ((c_custkey % 3 <> 0)::INT + (c_custkey % 5 <> 0)::INT)::INT AS n FROM customer WHERE c_custkey % 2 = 0 AND NOT (c_custkey % 3 = 0 AND c_custkey % 5 = 0)",
)
add(
    "snk07_unique_questions",
    lambda s, d: sinks.unique_questions(_pairs(s, d).withColumnRenamed("pair_id", "ordinal").select("ordinal", "document_id", "question_a", "question_b"), lambda side: F.concat_ws(":", "document_id", f"question_{side}")),
    "WITH s AS (SELECT c_custkey AS o, 0 AS side, c_mktsegment || ':q' || c_custkey % 40 AS question_key, 'q' || c_custkey % 40 AS question, c_mktsegment AS document_id FROM customer UNION ALL SELECT c_custkey, 1, c_mktsegment || ':q' || c_custkey % 50, 'q' || c_custkey % 50, c_mktsegment FROM customer) SELECT question_key, min(question) AS question, min(document_id) AS document_id FROM s GROUP BY 1",
)
