"""Result rows of an evaluation: the parsed prediction of an example, scored on its answer and on the place it gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import iou, pixel_box, unit_at
from ..functions.numbers import same_number
from ..functions.text import box_before_answer, canonical_variant, normal, same_answer, tag, tag_box

#: Columns that examples bring along as they are.
KEYS = ("group_id", "table_id", "question")


def result_rows(examples: DataFrame, evidence_first: bool = False) -> DataFrame:
    """One scored row an example.

    examples(group_id, table_id, variant, question, answer, row_header, column_header, target_id, box (thousandths), share (in
    [0, 1]), width, height, units: array<struct<id, box>>, prediction). A prediction gives answer, row, column and box in tags, or box
    and answer if ``evidence_first``; a tag that is missing or malformed is a null, never a failure. The predicted cell is the unit
    at the centre of the predicted box; with no valid box there is none, and the intersection is 0.
    """
    p = F.col("prediction")
    parsed = examples.withColumn("__answer", F.coalesce(tag(p, "answer"), F.lit(""))).withColumn("__box", tag_box(p))
    if not evidence_first:
        parsed = parsed.withColumn("__row", tag(p, "row")).withColumn("__column", tag(p, "column"))
    said = F.col("__answer") != ""
    right = lambda c: said & F.coalesce(c, F.lit(False))
    cell = F.when(F.col("__box").isNotNull(), unit_at(F.col("units"), F.col("__box"), F.col("target_id")))
    header = lambda a, b: normal(F.col(a)) == normal(F.col(b))
    numeric = right(same_number(F.col("__answer"), F.col("answer")))
    columns: list[Column] = [
        *map(F.col, KEYS),
        canonical_variant(F.col("variant")).alias("variant"),
        F.col("answer").alias("gold_answer"),
        p.alias("prediction_raw"),
        F.col("__answer").alias("prediction_answer"),
        numeric.alias("answer_correct"),
        right(same_answer(F.col("__answer"), F.col("answer"))).alias("exact_correct"),
        numeric.alias("numeric_correct"),
    ]
    if evidence_first:
        columns.append(box_before_answer(p).alias("bbox_before_answer"))
    else:
        columns += [F.col("row_header").alias("gold_row"), F.col("__row").alias("predicted_row"), header("__row", "row_header").alias("row_correct")]
        columns += [F.col("column_header").alias("gold_column"), F.col("__column").alias("predicted_column"), header("__column", "column_header").alias("column_correct")]
    return parsed.withColumn("__cell", cell).select(
        *columns,
        F.col("target_id").alias("gold_target_cell_id"),
        pixel_box(F.col("share"), F.col("width"), F.col("height")).alias("gold_bbox_pixel"),
        F.col("box").alias("gold_bbox_normalized"),
        F.col("__box").alias("predicted_bbox"),
        F.col("__box").isNotNull().alias("predicted_bbox_valid"),
        F.when(F.col("__box").isNotNull(), iou(F.col("__box"), F.col("box"))).otherwise(F.lit(0.0)).alias("bbox_iou"),
        F.col("__cell").alias("predicted_cell_id"),
        F.col("__cell").eqNullSafe(F.col("target_id")).alias("cell_correct"),
        F.lit("full_page").alias("setting"),
    )
