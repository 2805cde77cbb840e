"""Domain-shaped DataFrames derived from the supplied tables, each with the SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


VARIANTS = ("clean", "target_value_replacement", "Header Swap", "irrelevant-cell replacement")


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Prediction rows: setting, group_id, variant (as spelled by a producer), scale, exact, numeric, ordinal columns."""
    raw = F.element_at(F.array(*map(F.lit, VARIANTS)), (F.col("l_linenumber") % 4 + 1).cast("int"))
    return table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("setting"),
        F.col("l_orderkey").alias("group_id"),
        raw.alias("variant"),
        F.col("l_linestatus").alias("scale"),
        (F.col("l_discount") < 0.05).alias("exact"),
        (F.col("l_discount") < 0.06).alias("numeric"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate").alias("ordinal"),
    )


PREDICTIONS_SQL = """predictions AS (SELECT l_returnflag AS setting, l_orderkey AS group_id,
  CASE l_linenumber % 4 WHEN 0 THEN 'clean' WHEN 1 THEN 'target_value' WHEN 2 THEN 'header_address_swap' ELSE 'irrelevant_value' END AS variant,
  l_linestatus AS scale, l_discount < 0.05 AS exact, l_discount < 0.06 AS numeric,
  row_number() OVER (ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_orderkey, l_discount) AS ordinal FROM lineitem)"""


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Pair outcomes: pair_id, table_id, document_id, correct_a, correct_b, a_captured, b_captured, collapsed."""
    n = F.col("n_chars")
    a, b = F.col("quality") == 1, F.col("toxic") == 0
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars"), "doc_id").select(
        F.col("doc_id").alias("pair_id"),
        F.col("source").alias("table_id"),
        F.col("lang").alias("document_id"),
        (a & (n % 5 != 0)).alias("correct_a"),
        (b & (n % 7 != 0)).alias("correct_b"),
        (~(a & (n % 5 != 0)) & (n % 2 == 0)).alias("a_captured"),
        (~(b & (n % 7 != 0)) & (n % 2 == 1)).alias("b_captured"),
        (n % 11 == 0).alias("collapsed"),
        n.alias("n"),
    )


OUTCOMES_SQL = """outcomes AS (SELECT doc_id AS pair_id, source AS table_id, lang AS document_id,
  quality = 1 AND n_chars % 5 <> 0 AS correct_a, toxic = 0 AND n_chars % 7 <> 0 AS correct_b,
  NOT (quality = 1 AND n_chars % 5 <> 0) AND n_chars % 2 = 0 AS a_captured, NOT (toxic = 0 AND n_chars % 7 <> 0) AND n_chars % 2 = 1 AS b_captured,
  n_chars % 11 = 0 AS collapsed, n_chars AS n FROM labels JOIN documents USING (doc_id))"""


def facts(spark: SparkSession, d: str) -> DataFrame:
    """Table facts: table_id, metric, period, value, unit, scope and the order of arrival."""
    part = table(spark, d, "part").select("p_partkey", F.lower(F.concat_ws(" ", "p_type", "p_name")).alias("metric"))
    supplier = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("table_id"))
    lines = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", F.year("l_shipdate").alias("year"), "l_quantity", F.col("l_returnflag").alias("unit"), F.col("l_linestatus").alias("scope"))
    joined = lines.join(part, lines.l_partkey == part.p_partkey).join(supplier, lines.l_suppkey == supplier.s_suppkey)
    return joined.groupBy("table_id", "metric", F.col("year").cast("string").alias("period"), "unit", "scope").agg(F.sum("l_quantity").cast("bigint").alias("value"), F.min("l_partkey").alias("arrival"))


FACTS_SQL = """facts AS (SELECT s_nationkey AS table_id, lower(concat_ws(' ', p_type, p_name)) AS metric, year(l_shipdate)::VARCHAR AS period,
  l_returnflag AS unit, l_linestatus AS scope, sum(l_quantity)::BIGINT AS value, min(l_partkey) AS arrival
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"""


def grid(spark: SparkSession, d: str) -> DataFrame:
    """Cells of text grids: table_id, row_idx, col_idx, text. Two header rows, labels in column 0, years in row 1."""
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.col("c_acctbal").cast("decimal(12,2)").alias("v"), "c_mktsegment")
    row, col = (F.col("c_custkey") % 7 + 2).cast("int"), (F.floor(F.col("c_custkey") / 7) % 4 + 1).cast("int")
    cells = c.select(F.col("c_nationkey").alias("table_id"), row.alias("row_idx"), col.alias("col_idx"), F.concat(F.when(F.col("v") < 0, "(").otherwise(""), (F.abs(F.col("v")) + 10000).cast("decimal(12,2)").cast("string"), F.when(F.col("v") < 0, ")").otherwise("")).alias("text"))
    cells = cells.groupBy("table_id", "row_idx", "col_idx").agg(F.min("text").alias("text"))
    labels = cells.select("table_id", "row_idx", F.lit(0).alias("col_idx"), F.concat(F.when(F.col("row_idx") == 8, "Total").otherwise("Metric "), F.when(F.col("row_idx") == 8, "").otherwise(F.col("row_idx").cast("string"))).alias("text")).distinct()
    years = cells.select("table_id", F.lit(1).alias("row_idx"), "col_idx", (F.lit(2015) + F.col("col_idx")).cast("string").alias("text")).distinct()
    titles = cells.select("table_id", F.lit(0).alias("row_idx"), "col_idx", F.when(F.col("col_idx") <= 2, "Years ended").otherwise("In thousands").alias("text")).distinct()
    blanks = cells.select("table_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("row_idx"), F.lit(0).alias("col_idx"), F.lit("").alias("text")).distinct()
    return cells.unionByName(labels).unionByName(years).unionByName(titles).unionByName(blanks)


GRID_SQL = """cells0 AS (SELECT c_nationkey AS table_id, (c_custkey % 7 + 2)::INT AS row_idx, (c_custkey // 7 % 4 + 1)::INT AS col_idx,
  min(CASE WHEN c_acctbal::DECIMAL(12,2) < 0 THEN '(' ELSE '' END || (abs(c_acctbal::DECIMAL(12,2)) + 10000)::DECIMAL(12,2)::VARCHAR || CASE WHEN c_acctbal::DECIMAL(12,2) < 0 THEN ')' ELSE '' END) AS text FROM customer GROUP BY 1, 2, 3),
grid AS (SELECT * FROM cells0
  UNION ALL SELECT DISTINCT table_id, row_idx, 0, CASE WHEN row_idx = 8 THEN 'Total' ELSE 'Metric ' || row_idx END FROM cells0
  UNION ALL SELECT DISTINCT table_id, 1, col_idx, (2015 + col_idx)::VARCHAR FROM cells0
  UNION ALL SELECT DISTINCT table_id, 0, col_idx, CASE WHEN col_idx <= 2 THEN 'Years ended' ELSE 'In thousands' END FROM cells0
  UNION ALL SELECT DISTINCT table_id, r.r, 0, '' FROM cells0, (VALUES (0), (1)) r(r))"""


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """Two ordered boxes a row with whole coordinates 0 to 1000: vec_id, label, a, b (arrays)."""
    e = F.col("embedding")
    at = lambda i: F.floor((F.greatest(F.least(e[i].cast("double"), F.lit(1.0)), F.lit(-1.0)) + 1) * 500).cast("int")
    box = lambda k: F.array(F.least(at(k), at(k + 2)), F.least(at(k + 1), at(k + 3)), F.greatest(at(k), at(k + 2)), F.greatest(at(k + 1), at(k + 3)))
    return table(spark, d, "embeddings").select("vec_id", "label", box(0).alias("a"), box(4).alias("b"))


def _at(i: int) -> str:
    return f"floor((greatest(least(embedding[{i + 1}]::DOUBLE, 1.0), -1.0) + 1) * 500)::INT"


def _box(k: int) -> str:
    return f"[least({_at(k)}, {_at(k + 2)}), least({_at(k + 1)}, {_at(k + 3)}), greatest({_at(k)}, {_at(k + 2)}), greatest({_at(k + 1)}, {_at(k + 3)})]"


BOXES_SQL = f"boxes AS (SELECT vec_id, label, {_box(0)} AS a, {_box(4)} AS b FROM embeddings)"


def number_texts(spark: SparkSession, d: str) -> DataFrame:
    """Numbers written in many ways: id, a, b."""
    v = F.col("o_totalprice").cast("decimal(14,2)")
    k = F.col("o_orderkey") % 8
    whole = F.format_number(F.floor(v), 0)
    a = F.when(k == 0, F.concat(F.lit("("), F.format_number(v, 2), F.lit(")"))).when(k == 1, F.concat(F.lit("$ "), whole)).when(k == 2, F.concat(F.lit("Answer: "), v.cast("string"), F.lit("%"))).when(k == 3, F.regexp_replace(whole, ",", ".")).when(k == 4, F.concat(F.lit("about "), whole, F.lit(" in all"))).when(k == 5, F.concat(F.lit("-"), v.cast("string"))).when(k == 6, F.lit("no number")).otherwise(v.cast("string"))
    b = F.when(F.col("o_orderkey") % 3 == 0, v.cast("string")).when(F.col("o_orderkey") % 3 == 1, (v * 1000).cast("decimal(18,2)").cast("string")).otherwise(whole)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), a.alias("a"), b.alias("b"))


NUMBER_TEXTS_SQL = """number_texts AS (SELECT o_orderkey AS id, CASE o_orderkey % 8 WHEN 0 THEN '(' || format('{:,.2f}', o_totalprice::DECIMAL(14,2)) || ')'
  WHEN 1 THEN '$ ' || format('{:,}', floor(o_totalprice::DECIMAL(14,2))::BIGINT) WHEN 2 THEN 'Answer: ' || o_totalprice::DECIMAL(14,2)::VARCHAR || '%'
  WHEN 3 THEN replace(format('{:,}', floor(o_totalprice::DECIMAL(14,2))::BIGINT), ',', '.') WHEN 4 THEN 'about ' || format('{:,}', floor(o_totalprice::DECIMAL(14,2))::BIGINT) || ' in all'
  WHEN 5 THEN '-' || o_totalprice::DECIMAL(14,2)::VARCHAR WHEN 6 THEN 'no number' ELSE o_totalprice::DECIMAL(14,2)::VARCHAR END AS a,
  CASE o_orderkey % 3 WHEN 0 THEN o_totalprice::DECIMAL(14,2)::VARCHAR WHEN 1 THEN (o_totalprice::DECIMAL(14,2) * 1000)::DECIMAL(18,2)::VARCHAR
  ELSE format('{:,}', floor(o_totalprice::DECIMAL(14,2))::BIGINT) END AS b FROM orders)"""
