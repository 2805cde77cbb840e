"""Queries over variant packets, company records, grid layouts and the frozen selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import is_numeric
from ..operators import company as c
from ..operators import layout as la
from ..operators import pairs as p
from ..operators import records as r
from ..operators import tables as t
from ..operators import variants as va
from ..sources import frozen
from .carriers import BOXES_SQL, GRID_SQL, boxes, grid, table
from .mining import _NUM, _YEAR, _capped_pairs
from .mining import SQL as MINING

QUERIES, SQL = {}, {}


def add(name, query, sql):
    QUERIES[name], SQL[name] = query, sql


def _text(c):
    return F.col(c).cast("string")


def _packets(s, d):
    """Numeric cells as answers with their headers, and three plans each: new value, new year, a cell elsewhere."""
    h = t.with_headers(grid(s, d)).where((F.col("text") != "") & is_numeric(F.col("text")))
    return h.withColumn("group_id", va.group_id("grid", _text("table_id"), F.concat_ws("_", _text("row_idx"), _text("col_idx"))))


def _refs(s, d):
    h = _packets(s, d)
    answers = h.select("group_id", F.lit("answer").alias("role"), F.lit(0).alias("place"), "row_idx", "col_idx", "text")
    headers = lambda role: h.select("group_id", F.lit(role).alias("role"), F.posexplode(f"{role}_headers").alias("place", "h")).select("group_id", "role", "place", "h.*")
    return answers.unionByName(headers("row")).unionByName(headers("column"))


def _patches(s, d):
    h = _packets(s, d)
    year = F.try_element_at("column_headers", F.lit(-1))
    patch = lambda name, row, col, text: F.struct(F.lit(name).alias("variant"), row.cast("int").alias("row_idx"), col.cast("int").alias("col_idx"), text.alias("new_text"))
    plans = F.array(
        patch("target_value", F.col("row_idx"), F.col("col_idx"), F.concat(F.lit("T"), _text("row_idx"))),
        F.when(year.isNotNull(), patch("header_address_swap", year.row_idx, year.col_idx, F.lit("2099"))),
        patch("irrelevant_value", F.col("row_idx"), F.col("col_idx") + 100, F.lit("0")),
    )
    return h.select("group_id", F.explode(F.array_compact(plans)).alias("p")).select("group_id", "p.*")


_ABOVE = f"FROM grid h WHERE h.table_id = c.table_id AND h.col_idx = c.col_idx AND h.row_idx < c.row_idx AND {_YEAR('h.text')}"
_PACKETS = f"""{GRID_SQL}, b AS (SELECT 'grid_' || c.table_id || '_' || c.row_idx || '_' || c.col_idx AS group_id, c.row_idx, c.col_idx, c.text,
  (SELECT arg_max(h.text, h.col_idx) FROM grid h WHERE h.table_id = c.table_id AND h.row_idx = c.row_idx AND h.col_idx < c.col_idx AND h.text <> '' AND NOT {_NUM('h.text')}) AS metric,
  (SELECT arg_max(h.text, h.row_idx) {_ABOVE}) AS period, (SELECT max(h.row_idx) {_ABOVE}) AS year_row FROM grid c WHERE c.text <> '' AND {_NUM('c.text')}),
pl AS (SELECT group_id, 'target_value' AS variant, row_idx, col_idx, 'T' || row_idx AS new_text FROM b
  UNION ALL SELECT group_id, 'header_address_swap', year_row, col_idx, '2099' FROM b WHERE year_row IS NOT NULL
  UNION ALL SELECT group_id, 'irrelevant_value', row_idx, col_idx + 100, '0' FROM b)"""
_PAYLOADS = lambda mark: f"""SELECT group_id, 'clean' AS variant, text AS answer, metric, period, '' AS changed FROM b
UNION ALL SELECT group_id, variant, CASE variant WHEN 'target_value' THEN new_text ELSE text END, metric, CASE variant WHEN 'header_address_swap' THEN new_text ELSE period END,
  format('r{{:02d}}{mark}{{:02d}}', pl.row_idx, pl.col_idx) FROM pl JOIN b USING (group_id)"""  # noqa: E731


def _shown(payloads):
    return payloads.select("group_id", "variant", "answer", "metric", "period", F.array_join("changed_cell_ids", ",").alias("changed"))


add("prj02_variant_payloads", lambda s, d: _shown(va.variant_payloads(_refs(s, d), _patches(s, d), labelled=True)), f"WITH {_PACKETS} {_PAYLOADS('C')}")
add(
    "prj03_group_records",
    lambda s, d: _shown(r.flatten_variants(va.group_records(_refs(s, d), _patches(s, d)), ["clean", "target_value", "header_address_swap", "irrelevant_value"])),
    f"WITH {_PACKETS} {_PAYLOADS('c')}",
)
add(
    "prj08_plan_view",
    lambda s, d: va.plan_view(_patches(s, d)),
    f"""WITH {_PACKETS} SELECT group_id, variant, '{{"changes":[{{"cell_id":"' || format('r{{:02d}}c{{:02d}}', row_idx, col_idx) || '","row_idx":' || row_idx || ',"col_idx":' || col_idx || ',"new_text":"' || new_text || '"}}]}}' AS plan FROM pl""",
)


def _kpis(s, d):
    a, k = F.col("a"), F.col("vec_id")
    say = lambda head, tail: F.concat(F.lit(head), tail.cast("string"))
    return boxes(s, d).select(
        say("doc", F.col("label")).alias("document_id"),
        say("p", k % 3).alias("page_id"),
        k.alias("instance_index"),
        F.lit("train").alias("split"),
        say("img/", k).alias("image_path"),
        F.lit(2000).alias("width"),
        F.lit(1250).alias("height"),
        say("m", k % 5).alias("metric"),
        F.lit("2019").alias("period"),
        F.concat(F.lit("("), (k + 1).cast("string"), F.lit(")")).alias("answer"),
        say("q", k).alias("question"),
        F.array(a[1], a[0], a[3] + 1, a[2] + 1).alias("bbox"),
        (k % 7).alias("group_index"),
    )


add(
    "prj05_company_records",
    lambda s, d: c.company_records(_kpis(s, d)).select("group_id", "document_id", "question", F.col("evidence.target_id").alias("target_id"), F.col("evidence_units")[0].id.alias("unit_id"), "answer.raw", "answer.normalised_value", "answer.metric", F.array_join(F.transform("evidence.bbox_normalised", lambda v: F.round(v * 1000000).cast("bigint")), " ").alias("box")),
    f"""WITH {BOXES_SQL}, k AS (SELECT *, 'field_' || substr(sha256('doc' || label || '|p' || vec_id % 3 || '|' || vec_id || '|m' || vec_id % 5), 1, 16) AS id FROM boxes)
SELECT 'company_doc' || label || '_p' || vec_id % 3 || '_' || vec_id || '_m' || vec_id % 5 || '_' || lpad((vec_id % 7)::VARCHAR, 6, '0') AS group_id, 'doc' || label AS document_id, 'q' || vec_id AS question, id AS target_id, id AS unit_id,
'(' || (vec_id + 1) || ')' AS raw, -(vec_id + 1)::DOUBLE AS normalised_value, 'm' || vec_id % 5 AS metric, concat_ws(' ', a[1] * 500, a[2] * 800, (a[3] + 1) * 500, (a[4] + 1) * 800) AS box FROM k""",
)


def _export(s, d):
    k = F.col("c_custkey")
    box = F.array(*(F.lit(float(i)) for i in range(4)))
    return table(s, d, "customer").select(
        F.col("c_nationkey").alias("document_id"),
        F.lit("1").alias("page_id"),
        F.when(k % 2 == 0, "fields").otherwise("table").alias("surface"),
        F.when(k % 5 != 0, "company_profile").otherwise("other").alias("group"),
        k.alias("instance_index"),
        F.create_map(F.lit("name"), F.when(k % 3 == 0, " ").otherwise(F.col("c_name")), F.lit("phone"), F.when(k % 4 != 0, F.col("c_mktsegment"))).alias("values"),
        F.create_map(F.lit("name"), box, F.lit("phone"), F.when(k % 7 != 0, box)).alias("boxes"),
    )


def _profiles(s, d):
    keyed = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e.key, e.value)), ",")
    instances = F.transform("instances", lambda i: F.concat_ws(":", i.instance_index.cast("string"), keyed(i["values"])))
    lines = F.transform("table_rows", lambda i: F.concat_ws(":", i.row_index.cast("string"), keyed(i["values"]), F.array_join(F.map_keys(i["boxes"]), ",")))
    return c.profile_documents(_export(s, d)).select("document_id", F.array_join(instances, ";").alias("instances"), F.array_join(lines, ";").alias("table_rows"))


add(
    "src11_profile_documents",
    _profiles,
    """WITH v AS (SELECT *, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS a, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS b FROM customer),
w AS (SELECT *, c_custkey % 5 <> 0 AND (a IS NOT NULL OR b IS NOT NULL) AS kept, c_custkey || ':' || concat_ws(',', 'name=' || a, 'phone=' || b) AS t,
  concat_ws(',', CASE WHEN a IS NOT NULL THEN 'name' END, CASE WHEN b IS NOT NULL AND c_custkey % 7 <> 0 THEN 'phone' END) AS boxes FROM v)
SELECT c_nationkey AS document_id, coalesce(string_agg(t, ';' ORDER BY c_custkey) FILTER (WHERE kept AND c_custkey % 2 = 0), '') AS instances,
coalesce(string_agg(t || ':' || boxes, ';' ORDER BY c_custkey) FILTER (WHERE kept AND c_custkey % 2 = 1), '') AS table_rows FROM w GROUP BY 1""",
)
add(
    "geo07_layout",
    lambda s, d: la.layout(grid(s, d)).select("table_id", "axis", F.array_join("edges", " ").alias("edges")),
    f"""WITH {GRID_SQL}, z AS (SELECT table_id, 'column' AS axis, col_idx AS idx, max(CASE WHEN text = '' THEN 40 ELSE greatest(40, length(text) * 7 + 24) END) AS size FROM grid GROUP BY 1, 2, 3
  UNION ALL SELECT table_id, 'row', row_idx, max(CASE WHEN text = '' THEN 20 ELSE 24 END) FROM grid GROUP BY 1, 2, 3),
m AS (SELECT table_id, axis, unnest(range(max(idx) + 1)) AS idx FROM z GROUP BY 1, 2),
e AS (SELECT table_id, axis, idx, sum(coalesce(size, CASE axis WHEN 'column' THEN 40 ELSE 20 END)) OVER (PARTITION BY table_id, axis ORDER BY idx)::BIGINT AS edge FROM m LEFT JOIN z USING (table_id, axis, idx))
SELECT table_id, axis, '0 ' || string_agg(edge::VARCHAR, ' ' ORDER BY idx) AS edges FROM e GROUP BY 1, 2""",
)
add(
    "snk06_frozen_audit",
    lambda s, d: frozen.frozen_audit(p.primary_selection(_capped_pairs(s, d), 7, 5, 60, 20).withColumnRenamed("rule", "construction_rule")),
    f"""WITH sel AS ({MINING['smp09_primary_selection']}), n AS (SELECT table_id, count(*) AS n FROM sel GROUP BY 1)
SELECT (SELECT count(*) FROM sel WHERE rule = 'adjacent') AS adjacent, (SELECT count(*) FROM sel WHERE rule = 'skip') AS skip, coalesce(min(n), 0) AS fewest, coalesce(max(n), 0) AS most,
coalesce(list(n ORDER BY n)[count(*) // 2 + 1], 0) AS median, count(*) AS tables FROM n""",
)
