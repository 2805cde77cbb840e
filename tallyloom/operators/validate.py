"""Record validation as reasons: exact keys on raw JSON, and rules over nested records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_arithmetic, is_numeric, number_text, scalar_answer, strings

CLEAN_KEYS = ("group_id", "source", "split", "document_id", "template_family", "image_path", "question", "answer", "evidence", "evidence_units", "counterfactual_policy")
VARIANTS = ("clean", "target_value", "header_address_swap", "irrelevant_value")

UNIT = "struct<id:string,type:string,text:string,bbox_normalised:array<double>,role:string>"
RECORD = f"group_id string, source string, split string, document_id string, template_family string, image_path string, question string, answer struct<raw:string,normalised_value:double,unit:string,scale:string,metric:string,period:string>, evidence struct<type:string,target_id:string,bbox_normalised:array<double>,row_header_ids:array<string>,column_header_ids:array<string>,unit_ids:array<string>>, evidence_units array<{UNIT}>, counterfactual_policy struct<allowed_types:array<string>>"


def key_differences(line: Column, expected: tuple[str, ...] = CLEAN_KEYS) -> tuple[Column, Column]:
    """Missing and extra keys of a raw JSON object, sorted; all are missing where the line is no object."""
    keys = F.coalesce(F.json_object_keys(line), F.array().cast("array<string>"))
    return F.array_sort(F.array_except(strings(expected), keys)), F.array_sort(F.array_except(keys, strings(expected)))


def is_unit_box(b: Column) -> Column:
    return F.coalesce((F.size(b) == 4) & F.forall(b, lambda x: x.between(0.0, 1.0)) & (b[2] > b[0]) & (b[3] > b[1]), F.lit(False))


def filled(c: Column) -> Column:
    return F.coalesce(F.trim(c) != "", F.lit(False))


def record_violations(r: str = "") -> Column:
    """All rules that a typed clean record breaks, in order."""
    c = lambda name: F.col(f"{r}{name}")
    ids = F.transform(c("evidence_units"), lambda u: u.id)
    headers = F.concat(*(F.coalesce(c(f"evidence.{k}"), F.array().cast("array<string>")) for k in ("row_header_ids", "column_header_ids", "unit_ids")))
    rules = {
        "blank_text": ~(filled(c("group_id")) & filled(c("question")) & filled(c("image_path"))),
        "answer_raw": ~filled(c("answer.raw")),
        "answer_number": c("answer.normalised_value").isNull(),
        "no_units": F.coalesce(F.size(c("evidence_units")) <= 0, F.lit(True)),
        "repeated_unit": F.coalesce(F.size(F.array_distinct(ids)) < F.size(ids), F.lit(False)),
        "unit_box": F.coalesce(F.exists(c("evidence_units"), lambda u: ~is_unit_box(u.bbox_normalised)), F.lit(False)),
        "unknown_target": ~F.coalesce(F.array_contains(ids, c("evidence.target_id")), F.lit(False)),
        "unknown_header": F.size(F.array_except(headers, F.coalesce(ids, F.array().cast("array<string>")))) > 0,
        "evidence_box": ~is_unit_box(c("evidence.bbox_normalised")),
        "policy": ~F.coalesce(F.forall(c("counterfactual_policy.allowed_types"), filled), F.lit(False)),
    }
    return F.array_compact(F.array(*(F.when(v, F.lit(k)) for k, v in rules.items())))


def group_violations(names: Column, changed: Column) -> Column:
    """Rules over a group's variants. names: map key to the payload's own name, changed: map key to its changed cells."""
    keys = F.array_sort(F.map_keys(names))
    rules = {
        "variant_set": keys != F.array_sort(strings(VARIANTS)),
        "variant_name": F.exists(F.map_entries(names), lambda e: ~F.coalesce(e.key == e.value, F.lit(False))),
        "clean_changed": F.coalesce(F.size(F.try_element_at(changed, F.lit("clean"))) > 0, F.lit(False)),
        "counterfactual_unchanged": F.exists(F.map_entries(changed), lambda e: (e.key != "clean") & (F.coalesce(F.size(e.value), F.lit(0)) <= 0)),
    }
    return F.array_compact(F.array(*(F.when(F.coalesce(v, F.lit(True)), F.lit(k)) for k, v in rules.items())))


def grounding_reason(p: str = "payload") -> Column:
    """The first reason against a grounding payload, null for none; single row and column headers are asked for."""
    c = lambda name: F.col(f"{p}.{name}")
    ids = F.transform(c("evidence_units"), lambda u: u.id)
    known = lambda x: F.coalesce(F.array_contains(ids, x), F.lit(False))
    header = lambda k: (F.coalesce(F.size(c(f"evidence.{k}")), F.lit(0)), F.get(c(f"evidence.{k}"), F.lit(0)))
    (nr, row), (nc, col) = header("row_header_ids"), header("column_header_ids")
    text = lambda x: F.get(F.filter(c("evidence_units"), lambda u: u.id == x), F.lit(0)).text
    unsafe = lambda t: F.coalesce(t.rlike("[<>]"), F.lit(False))
    return (
        F.when(c("evidence").isNull(), "missing_evidence")
        .when(~known(c("evidence.target_id")), "unknown_target")
        .when(nr == 0, "missing_row_header")
        .when(nr > 1, "multiple_row_headers")
        .when(~known(row), "unknown_row_header")
        .when(nc == 0, "missing_column_header")
        .when(nc > 1, "multiple_column_headers")
        .when(~known(col), "unknown_column_header")
        .when(~is_unit_box(c("evidence.bbox_normalised")), "invalid_bbox")
        .when(~filled(c("answer.raw")), "missing_answer")
        .when(unsafe(c("answer.raw")) | unsafe(text(row)) | unsafe(text(col)), "unsafe_text")
    )


def question_reason(q: DataFrame) -> DataFrame:
    """Adds reason: 'accepted' for direct extraction questions, else the first reason against."""
    answer = scalar_answer(F.col("answer"))
    kind = F.lower(F.coalesce("answer_type", F.lit("")))
    facts = F.transform(F.coalesce("facts", F.array().cast("array<string>")), number_text)
    derivation = F.trim(F.coalesce("derivation", F.lit("")))
    direct = F.array_contains(F.concat(F.array(number_text(answer)), facts), number_text(derivation))
    reason = (
        F.when(F.coalesce("req_comparison", F.lit(False)), "comparison_required")
        .when(answer.isNull(), "non_scalar_answer")
        .when(~is_numeric(answer), "non_numeric_answer")
        .when(~kind.isin("span", "arithmetic"), F.concat(F.lit("unsupported_answer_type_"), F.coalesce(F.nullif(kind, F.lit("")), F.lit("missing"))))
        .when((kind == "arithmetic") & (derivation == ""), "missing_direct_derivation")
        .when((kind == "arithmetic") & has_arithmetic(derivation), "arithmetic_derivation")
        .when((kind == "arithmetic") & ~direct, "derivation_not_direct_answer")
        .otherwise("accepted")
    )
    return q.withColumn("reason", reason)


def strict(df: DataFrame, violations: str = "violations") -> DataFrame:
    """Fails on the first record with a violation."""
    return df.where(F.when(F.size(violations) > 0, F.raise_error(F.concat(F.lit("invalid record: "), F.to_json(violations))).cast("boolean")).otherwise(True))


def first_invalid_variant(variants: DataFrame) -> DataFrame:
    """(group_id, reason): of a group's variants in their fixed order the first reason, null for valid groups."""
    rank = F.array_position(strings(VARIANTS), F.col("variant"))
    return variants.groupBy("group_id").agg(F.min_by("reason", F.when(F.col("reason").isNotNull(), rank)).alias("reason"))


def split_leaks(records: DataFrame, key: str = "key", split: str = "split") -> DataFrame:
    """Keys that occur in more than one split, with the splits."""
    return records.groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("splits")).where(F.size("splits") > 1)
