"""Group records: every variant's packet read again off the patched cells, nested by variant name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import slug
from .records import metric_and_period, nest_variants
from .tables import cell_id


def group_id(source: str, table: Column, question: Column) -> Column:
    return F.concat_ws("_", F.lit(source), slug(table), slug(question))


def variant_payloads(refs: DataFrame, patches: DataFrame, labelled: bool = False) -> DataFrame:
    """(group_id, variant, answer, row_headers, column_headers, metric, period, changed_cell_ids), clean among the variants.

    refs(group_id, role: answer, row or column, place, row_idx, col_idx, text) are the cells a packet rests on, and
    patches(group_id, variant, row_idx, col_idx, new_text) the plans. A packet reads only its own cells, so they alone meet
    the patches and no grid is copied per plan; all steps share the key group_id. ``labelled`` chooses the spelling of ids.
    """
    key = ["group_id", "variant", "row_idx", "col_idx"]
    plans = patches.groupBy("group_id", "variant").agg(F.array_sort(F.collect_set(cell_id(F.col("row_idx"), F.col("col_idx"), labelled))).alias("changed_cell_ids"))
    clean = refs.select("group_id").distinct().select("group_id", F.lit("clean").alias("variant"), F.array().cast("array<string>").alias("changed_cell_ids"))
    cells = refs.join(plans.unionByName(clean), "group_id").join(patches.select(*key, "new_text"), key, "left")
    text = F.coalesce("new_text", "text")
    headers = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("place", text.alias("text"))))), lambda h: h.text)
    packet = cells.groupBy("group_id", "variant").agg(F.max(F.when(F.col("role") == "answer", text)).alias("answer"), headers("row").alias("row_headers"), headers("column").alias("column_headers"), F.first("changed_cell_ids").alias("changed_cell_ids"))
    return packet.withColumn("__mp", metric_and_period(F.col("row_headers"), F.col("column_headers"))).select("group_id", "variant", "answer", "row_headers", "column_headers", F.col("__mp.metric").alias("metric"), F.col("__mp.period").alias("period"), "changed_cell_ids")


def group_records(refs: DataFrame, patches: DataFrame, labelled: bool = False) -> DataFrame:
    """One record a group: its variants as a map from name to payload."""
    return nest_variants(variant_payloads(refs, patches, labelled), [])


def plan_view(patches: DataFrame, labelled: bool = False) -> DataFrame:
    """(group_id, variant, plan): the changes of a plan as one JSON text, by cell."""
    change = F.struct(cell_id(F.col("row_idx"), F.col("col_idx"), labelled).alias("cell_id"), "row_idx", "col_idx", "new_text")
    return patches.groupBy("group_id", "variant").agg(F.to_json(F.struct(F.array_sort(F.collect_list(change)).alias("changes"))).alias("plan"))
