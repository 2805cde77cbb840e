"""Record builders: clean and group records, flattened variants, pair records, prediction rows, views, prompts and joins of manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import same_number, strict_value
from ..functions.text import YEAR, compact, question_key, same_answer, slug
from .ranks import positions

GROUNDING_TAGS = "<answer>...</answer>\n<row>...</row>\n<column>...</column>\n<bbox>x0 y0 x1 y1</bbox>"


def metric_and_period(row_headers: Column, column_headers: Column) -> Column:
    """struct(metric, period): the last row header; the last year-like column header, else the last one."""
    years = F.filter(column_headers, lambda t: t.rlike(YEAR))
    last = lambda a: F.try_element_at(a, F.lit(-1))
    return F.struct(last(row_headers).alias("metric"), F.coalesce(last(years), last(column_headers)).alias("period"))


def clean_records(q: DataFrame, source: str) -> DataFrame:
    """Questions with their packet as clean records. q(document, question, answer, row_headers, column_headers, image_path)."""
    mp = metric_and_period(F.col("row_headers"), F.col("column_headers"))
    answer = F.struct(compact(F.col("answer")).alias("raw"), strict_value(F.col("answer")).alias("normalised_value"), mp.metric.alias("metric"), mp.period.alias("period"))
    return q.select(F.concat_ws("_", F.lit(source), slug(F.col("document")), slug(F.col("question"))).alias("group_id"), F.lit(source).alias("source"), F.col("document").alias("document_id"), "question", "image_path", answer.alias("answer"), F.concat(F.lit("field_"), F.substring(F.sha2(F.concat_ws("|", "document", "question"), 256), 1, 16)).alias("evidence_id"))


def nest_variants(rows: DataFrame, shared: list[str]) -> DataFrame:
    """Group records: variant rows as a map from variant to payload beside the shared fields."""
    payload = F.struct(*(c for c in rows.columns if c not in (*shared, "group_id", "variant")))
    entries = F.array_sort(F.collect_list(F.struct("variant", payload.alias("payload"))))
    return rows.groupBy("group_id", *shared).agg(F.map_from_entries(entries).alias("variants"))


def flatten_variants(groups: DataFrame, wanted: list[str]) -> DataFrame:
    """Chosen variants as rows; groups without a variants map pass through as one row of variant clean."""
    keep = [c for c in groups.columns if c != "variants"]
    chosen = F.map_filter("variants", lambda k, v: F.array_contains(F.array(*map(F.lit, wanted)), k))
    rows = groups.where(F.col("variants").isNotNull()).select(*keep, F.explode(chosen).alias("variant", "payload"))
    plain = groups.where(F.col("variants").isNull()).select(*keep, F.lit("clean").alias("variant"), F.lit(None).cast(rows.schema["payload"].dataType).alias("payload"))
    return rows.unionByName(plain).select(*keep, "variant", "payload.*")


def prediction_rows(records: DataFrame, prediction: str = "prediction", target: str = "target") -> DataFrame:
    """Scored predictions; a failed one (an error or no text) stays and counts as wrong."""
    p, t = F.col(prediction), F.col(target)
    failed = F.col("error").isNotNull() | p.isNull()
    return records.withColumn("exact_correct", F.coalesce(~failed & same_answer(p, t), F.lit(False))).withColumn("numeric_correct", F.coalesce(~failed & same_number(p, t), F.lit(False)))


def pair_outcomes(pairs: DataFrame, predictions: DataFrame) -> DataFrame:
    """Both sides' predictions by question key; pairs with a side missing are left out.

    pairs(pair_id, table_id, document_id, question_a, answer_a, question_b, answer_b), predictions(label, question_key, prediction)
    """
    keyed = pairs
    for s in ("a", "b"):
        keyed = keyed.withColumn(f"key_{s}", question_key(F.col("document_id"), F.col(f"question_{s}"), F.lit(None).cast("string")))
    p = lambda s: predictions.select(*(["label"] if s == "a" else [F.col("label").alias("label_b")]), F.col("question_key").alias(f"key_{s}"), F.col("prediction").alias(f"prediction_{s}"))
    j = keyed.join(p("a"), "key_a")
    b = p("b")
    j = j.join(b, (j.key_b == b.key_b) & (j.label == b.label_b)).drop("label_b")
    ok = lambda x, y: same_number(F.col(x), F.col(y))
    return j.select("label", "pair_id", "table_id", "document_id", ok("prediction_a", "answer_a").alias("correct_a"), ok("prediction_b", "answer_b").alias("correct_b"), ok("prediction_a", "answer_b").alias("a_captured"), ok("prediction_b", "answer_a").alias("b_captured"), ok("prediction_a", "prediction_b").alias("collapsed"))


def resolve_images(tables: DataFrame, existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """Each table's image and where it comes from: an existing one, else a fresh one, else missing."""
    j = tables.join(existing.select("table_id", F.col("path").alias("__e")), "table_id", "left").join(fresh.select("table_id", F.col("path").alias("__f")), "table_id", "left")
    return j.withColumn("path", F.coalesce("__e", "__f")).withColumn("image_source", F.when(F.col("__e").isNotNull(), "existing").when(F.col("__f").isNotNull(), "fresh").otherwise("missing")).drop("__e", "__f")


def source_index(group_id: Column) -> Column:
    """The index, with its leading zeros, in a group id syn_<index>_<name>; any other id fails."""
    parts = F.split(group_id, "_")
    fine = F.coalesce((F.size(parts) >= 3) & (parts[0] == "syn"), F.lit(False))
    return F.when(fine, F.get(parts, F.lit(1))).otherwise(F.raise_error(F.concat(F.lit("no group id: "), F.coalesce(group_id, F.lit("null")))).cast("string"))


def source_table_key(table_id: Column, index: Column) -> Column:
    """id:<table id>, or index:<row number> for tables without an id."""
    return F.when(F.coalesce(table_id, F.lit("")) != "", F.concat(F.lit("id:"), table_id)).otherwise(F.concat(F.lit("index:"), index.cast("string")))


def packet_cell(raw: Column) -> Column:
    """A cell of a packet as read, struct<cell_id, text, bbox>, with whole coordinates and no null text; a box without four fails."""
    box = F.transform(raw["bbox"], lambda x: x.cast("int"))
    fine = F.when(F.coalesce(F.size(box) == 4, F.lit(False)), box).otherwise(F.raise_error(F.concat(F.lit("no box of cell "), F.coalesce(raw["cell_id"], F.lit("null")))).cast("array<int>"))
    return F.struct(raw["cell_id"].alias("cell_id"), F.coalesce(raw["text"], F.lit("")).alias("text"), fine.alias("bbox"))


def patch_texts(patches: Column) -> Column:
    """New texts by cell id of an array of struct<cell_id, new_text>: blank ids are left out, the last patch of a cell counts."""
    named = F.filter(patches, lambda p: F.coalesce(p["cell_id"], F.lit("")) != "")
    last = F.filter(named, lambda p, i: ~F.exists(F.slice(named, i + 2, F.size(named)), lambda q: q["cell_id"] == p["cell_id"]))
    return F.map_from_arrays(F.transform(last, lambda p: p["cell_id"]), F.transform(last, lambda p: F.coalesce(p["new_text"], F.lit(""))))


def patched(cells: Column, patches: Column) -> Column:
    """Packet cells with the texts of their patches."""
    texts = patch_texts(patches)
    return F.transform(cells, lambda c: F.struct(c["cell_id"].alias("cell_id"), F.coalesce(F.try_element_at(texts, c["cell_id"]), c["text"]).alias("text"), c["bbox"].alias("bbox")))


def replay(groups: DataFrame, source: DataFrame) -> DataFrame:
    """Groups matched to source rows by index and question (of repeated questions the last); unmatched ones are flagged.

    groups(group_id, question) with the index as the second part of the id; source(source_index, question, ordinal, row_id)
    """
    index = F.try_element_at(F.split("group_id", "_"), F.lit(2)).try_cast("bigint")
    one = source.groupBy("source_index", "question").agg(F.max_by("row_id", "ordinal").alias("row_id"))
    return groups.withColumn("source_index", index).join(one, ["source_index", "question"], "left").withColumn("mismatch", F.col("row_id").isNull())


def candidates(instances: DataFrame, used: DataFrame, allowed: DataFrame) -> DataFrame:
    """Metric rows of instances in allowed documents that no earlier benchmark used. instances(document_id, instance, values: map)."""
    kept = instances.join(used, ["document_id", "instance"], "left_anti").join(allowed, "document_id", "left_semi")
    return kept.select("document_id", "instance", F.explode("values").alias("metric", "value")).where(F.trim("value") != "")


def training_pairs(groups: DataFrame, visits: DataFrame) -> DataFrame:
    """A clean and a counterfactual view of each visit, with its place in the cycle; a kind that its group does not have fails.

    groups(group_id, question, variants: map<kind, struct<image_id, image_path, answer, target_id, evidence_ids, expected_behavior>>),
    visits(epoch, place, group_id, cycle, kind) as sampling.schedule makes them: three visits a cycle.
    """
    j = visits.join(groups.select("group_id", "question", "variants"), "group_id")
    view = lambda v: [v["image_id"].alias("image_id"), v["image_path"].alias("image"), F.col("question").alias("question"), v["answer"].alias("gold_answer"), v["target_id"].alias("target_cell_id"), v["evidence_ids"].alias("gold_evidence_ids")]
    found = F.try_element_at("variants", F.col("kind"))
    missing = F.raise_error(F.concat(F.lit("no variant "), F.coalesce("kind", F.lit("null")), F.lit(" of "), F.col("group_id").cast("string"))).cast(groups.schema["variants"].dataType.valueType)
    j = j.withColumn("__clean", F.element_at("variants", "clean")).withColumn("__cf", F.when(found.isNotNull() & (F.col("kind") != "clean"), found).otherwise(missing))
    cf = F.col("__cf")
    return j.select("epoch", "place", "group_id", F.struct(*view(F.col("__clean"))).alias("clean"), F.struct(*view(cf), F.col("kind").alias("cf_type"), cf["expected_behavior"].alias("expected_behavior")).alias("counterfactual"), F.col("cycle").alias("cycle_index"), F.pmod(F.col("epoch"), F.lit(3)).alias("position_in_cycle"))


def training_log(pairs: DataFrame, run_id: str) -> DataFrame:
    """A flat row a training pair, with its step over all epochs (by epoch, place and group)."""
    steps = positions(pairs, ["epoch", "place", "group_id"], "global_step")
    sides = [F.col(f"{side}.{field}").alias(f"{name}_{field}") for field in ("image_id", "gold_answer", "target_cell_id") for side, name in (("clean", "clean"), ("counterfactual", "cf"))]
    return steps.select(F.lit(run_id).alias("run_id"), "epoch", "global_step", "group_id", "cycle_index", "position_in_cycle", F.col("counterfactual.cf_type").alias("cf_type"), *sides)


def qa_prompt(question: Column) -> Column:
    """A question as a prompt; an empty one fails."""
    return F.when(F.coalesce(F.trim(question), F.lit("")) == "", F.raise_error(F.lit("empty question")).cast("string")).otherwise(F.concat(F.lit("Answer the question from the table image.\n\nQuestion: "), F.trim(question), F.lit("\nAnswer:")))


def grounding_prompt(question: Column) -> Column:
    return F.concat(F.lit("Answer the question from the table and give the place of the evidence in this form:\n\n" + GROUNDING_TAGS + "\n\nQuestion: "), F.trim(question))


def messages(prompt: Column, image: Column) -> Column:
    """A chat turn with an image part and a text part."""
    part = lambda kind, body: F.struct(F.lit(kind).alias("type"), body.alias("content"))
    return F.array(F.struct(F.lit("user").alias("role"), F.array(part("image", image), part("text", prompt)).alias("parts")))


def counterfactual_plans(answers: DataFrame, swaps: DataFrame, irrelevant: DataFrame, new_value: Column) -> DataFrame:
    """Cell edits of the four variants a question: none, the answer's new value, the header swap's value, the irrelevant cell's.

    Questions without a swap or an irrelevant cell have no plan. Rows: table_id, question, variant, col_idx, row_idx, new_text.
    """
    j = answers.join(swaps.select("table_id", "question", "peer_col", "peer_value"), ["table_id", "question"]).join(irrelevant.select("table_id", "question", F.col("row_idx").alias("ir"), F.col("col_idx").alias("ic"), F.col("text").alias("it")), ["table_id", "question"])
    edit = lambda name, r, c, t: F.struct(F.lit(name).alias("variant"), r.alias("row_idx"), c.alias("col_idx"), t.alias("new_text"))
    none = F.lit(None)
    plans = F.array(edit("clean", none.cast("int"), none.cast("int"), none.cast("string")), edit("target_value", F.col("row_idx"), F.col("col_idx"), new_value), edit("header_address_swap", F.col("row_idx"), F.col("col_idx"), F.col("peer_value")), edit("irrelevant_value", F.col("ir"), F.col("ic"), F.concat(F.col("it"), F.lit("1"))))
    return j.select("table_id", "question", F.inline(plans))
