"""Clean records of single facts read off company pages, and the documents that hold them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import from_tlbr, is_box, unit_box
from ..functions.numbers import strict_value
from ..sources.readers import field_instances


def evidence_id(document: Column, page: Column, instance: Column, metric: Column) -> Column:
    return F.concat(F.lit("field_"), F.substring(F.sha2(F.concat(document, F.lit("|"), page, F.lit("|"), instance.cast("string"), F.lit("|"), metric), 256), 1, 16))


def company_records(facts: DataFrame, template: str = "kpi_table") -> DataFrame:
    """One clean record a fact, with one evidence unit; a box without area fails.

    facts(document_id, page_id, instance_index, split, image_path, width, height, metric, period, answer, question,
    bbox: array of top, left, bottom, right, group_index)
    """
    b = F.col("bbox")
    box = from_tlbr(*(b[i].cast("double") for i in range(4)))
    box = F.when(is_box(box), unit_box(box, F.col("width"), F.col("height"))).otherwise(F.raise_error(F.lit("a box without area")).cast("array<double>"))
    name = F.concat_ws("_", F.lit("company"), "document_id", "page_id", F.col("instance_index").cast("string"), "metric", F.lpad(F.col("group_index").cast("string"), 6, "0"))
    rows = facts.withColumn("evidence_id", evidence_id(F.col("document_id"), F.col("page_id"), F.col("instance_index"), F.col("metric"))).withColumn("unit_box", box)
    nothing = F.array().cast("array<string>")
    return rows.select(
        name.alias("group_id"),
        F.lit("company").alias("source"),
        "split",
        "document_id",
        F.lit(template).alias("template_family"),
        "image_path",
        "question",
        F.struct(F.col("answer").alias("raw"), strict_value(F.col("answer")).alias("normalised_value"), F.lit(None).cast("string").alias("unit"), F.lit(None).cast("string").alias("scale"), "metric", "period").alias("answer"),
        F.struct(F.lit("region").alias("type"), F.col("evidence_id").alias("target_id"), F.col("unit_box").alias("bbox_normalised"), *(nothing.alias(f"{k}_ids") for k in ("row_header", "column_header", "unit_region"))).alias("evidence"),
        F.array(F.struct(F.col("evidence_id").alias("id"), F.lit("region").alias("type"), F.col("answer").alias("text"), F.col("unit_box").alias("bbox_normalised"), F.lit("target").alias("role"), F.struct("page_id", "instance_index").alias("metadata"))).alias("evidence_units"),
        F.struct(nothing.alias("allowed_types")).alias("counterfactual_policy"),
    )


def profile_documents(export: DataFrame, group: str = "company_profile") -> DataFrame:
    """(document_id, instances, table_rows) for every document of an export, those without values too.

    export(document_id, page_id, surface: fields or table, group, instance_index, values: map, boxes: map). Blank values and
    rows without values are left out; boxes are kept for the values of table rows only. The list of documents is combined before its shuffle.
    """
    rows = field_instances(export, group)
    boxes = F.map_filter("boxes", lambda k, v: F.map_contains_key("values", k))
    entries = lambda m: F.array_sort(F.map_entries(m))
    item = F.struct("page_id", "instance_index", entries(F.col("values")).alias("v"), entries(boxes).alias("b"))
    marked = rows.select("document_id", "surface", item.alias("item")).unionByName(export.select("document_id").distinct(), allowMissingColumns=True)
    of = lambda surface: F.array_sort(F.collect_list(F.when(F.col("surface") == surface, F.col("item"))))
    plain = lambda a, index, *more: F.transform(a, lambda i: F.struct(i.page_id.alias("page_id"), i.instance_index.alias(index), F.map_from_entries(i.v).alias("values"), *(F.map_from_entries(i.b).alias(m) for m in more)))
    one = marked.groupBy("document_id").agg(of("fields").alias("f"), of("table").alias("t"))
    return one.select("document_id", plain(F.col("f"), "instance_index").alias("instances"), plain(F.col("t"), "row_index", "boxes").alias("table_rows"))
