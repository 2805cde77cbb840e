"""Questions matched to the blocks that answer them, and records built from matched facts, instances and payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import month_number, whole_year
from ..functions.geometry import grid_box, union_box
from ..functions.text import compact, grounding_target, metric_tokens, number_text, once, period_in, periods, slug, tokens
from .pairs import numbered
from .validate import grounding_reason

#: Month names in order, and the readings that confirm a value.
MONTHS = "January February March April May June July August September October November December".split()
CONFIRMED = ("match", "match_word_set", "match_scale_or_sign")


def metric_period_match(question: Column, context: Column, least: int = 1, ratio: float = 0.5) -> Column:
    """struct(accepted, reason, metric, matched_tokens, overlap, periods, matched_periods) of a question and its blocks' text."""
    texts = F.struct(metric_tokens(question).alias("m"), periods(question).alias("p"), tokens(context).alias("seen"), context.alias("context"))
    matched = lambda x: F.struct(x.m.alias("m"), x.p.alias("p"), F.filter(x.m, lambda t: F.array_contains(x.seen, t)).alias("hit"), F.filter(x.p, lambda y: period_in(y, x.context)).alias("found"))

    def verdict(x):
        share = F.when(F.size(x.m) > 0, F.size(x.hit) / F.size(x.m)).otherwise(0.0)
        reason = F.when(F.size(x.m) == 0, "missing_metric_candidate").when(F.size(x.hit) < least, "metric_not_matched").when(share < ratio, "metric_overlap_below_threshold").when(F.size(x.p) == 0, "missing_period_candidate").when(F.size(x.found) == 0, "period_not_matched").otherwise("accepted")
        return F.struct((reason == "accepted").alias("accepted"), reason.alias("reason"), F.nullif(F.array_join(x.m, " "), F.lit("")).alias("metric"), x.hit.alias("matched_tokens"), F.round(share, 6).alias("overlap"), x.p.alias("periods"), x.found.alias("matched_periods"))

    # tokens and periods are found once a row: as columns they would be found again for every use, and for every token compared
    return once(once(texts, matched), verdict)


def words_text(words: Column) -> Column:
    """The texts of words, joined by blanks and compacted."""
    return compact(F.array_join(F.transform(words, lambda w: w.text), " "))


def words_of_chars(words: Column, text: Column, start: Column, end: Column) -> Column:
    """Words that a character span touches; the end may or may not be meant to belong to it, the shorter non-empty reading counts."""
    upto = lambda bound: F.filter(words, lambda w: (w.char_end > start) & (w.char_start < bound))
    short, long = upto(F.least(F.length(text), F.greatest(end, start + 1))), upto(F.least(F.length(text), end + 1))
    inside = (start >= 0) & (end >= start) & (start < F.length(text))
    return F.when(inside, F.when(F.size(short) > 0, short).otherwise(long))


def locate_evidence(questions: DataFrame, blocks: DataFrame) -> DataFrame:
    """(question_id, status, span_mode, text, word_indices, box) of each question's one mapped span.

    questions(question_id, document_id, mapping: an array of maps from block to span, answer, facts);
    blocks(document_id, block, text, words(index, text, char_start, char_end, box), box). A span is tried as characters, then
    as words; one whose characters say something else is fuzzy, and without any words the block stands for it.
    """
    first = F.get("mapping", F.lit(0))
    q = questions.withColumn("keys", F.map_keys(first)).withColumn("block", F.get("keys", F.lit(0)))
    j = q.withColumn("span", F.try_element_at(first, F.col("block"))).join(blocks.withColumn("known", F.lit(True)), ["document_id", "block"], "left")
    a, b = F.get("span", F.lit(0)), F.get("span", F.lit(1))
    j = j.withColumn("chars", words_of_chars(F.col("words"), F.col("text"), a, b))
    j = j.withColumn("slice", F.when((a >= 0) & (b > a) & (b <= F.size("words")), F.slice("words", a + 1, F.greatest(b - a, F.lit(0)))))
    has = F.coalesce(F.size("chars") > 0, F.lit(False))
    j = j.withColumn("as_chars", F.when(has, words_text(F.col("chars"))).when(a >= 0, compact(F.substring(F.col("text"), a + 1, b + 1 - a))).otherwise(""))
    j = j.withColumn("as_words", F.coalesce(words_text(F.col("slice")), F.lit("")))
    facts = F.filter(F.transform(F.coalesce("facts", F.array().cast("array<string>")), compact), lambda f: f != "")
    wanted = F.array_append(F.transform(facts, number_text), number_text(F.coalesce("answer", F.lit(""))))
    right = lambda t: (t != "") & F.array_contains(wanted, number_text(t))
    mode = F.when(right(F.col("as_chars")), "char").when(right(F.col("as_words")), "word").when(has, "char_fuzzy").otherwise("block")
    missing = F.when(F.coalesce(F.size("mapping"), F.lit(0)) != 1, "mapping_not_unique").when(F.coalesce(F.size("keys"), F.lit(0)) != 1, "mapping_block_not_unique").when(F.col("known").isNull(), "mapped_block_missing").when(F.coalesce(F.size("span"), F.lit(0)) != 2, "mapped_span_invalid")
    j = j.withColumn("span_mode", F.when(missing.isNull(), mode)).withColumn("missing", missing)
    chosen = F.when(F.col("span_mode").isin("char", "char_fuzzy"), F.col("chars")).when(F.col("span_mode") == "word", F.col("slice"))
    text = F.when(F.col("span_mode") == "word", F.col("as_words")).when(F.col("span_mode") == "block", compact(F.col("text"))).when(F.col("span_mode").isNotNull(), F.col("as_chars"))
    status = F.coalesce("missing", F.when(F.col("span_mode") == "char_fuzzy", "accepted_fuzzy_text").when(F.col("span_mode") == "block", "accepted_block_only").otherwise("accepted"))
    box = F.when(F.col("span_mode").isNotNull(), F.coalesce(union_box(F.transform(chosen, lambda w: w.box)), F.col("box")))
    return j.select("question_id", status.alias("status"), "span_mode", text.alias("text"), F.transform(chosen, lambda w: w.index).alias("word_indices"), box.alias("box"))


def _month_year(month: Column, year: Column) -> Column:
    name = F.get(F.array(*map(F.lit, MONTHS)), month_number(month).cast("int") - 1)
    return F.concat(name, F.lit(" "), whole_year(year))


def embedded_date(c: Column) -> Column:
    """Month and year of a whole date, or of a month with a year, written in one field; else null."""
    t, sep = F.trim(c), r"[./-]"
    full, part = rf"^\d{{1,2}}{sep}(\d{{1,2}}){sep}(\d{{2,4}})$", rf"^(\d{{1,2}}){sep}(\d{{2,4}})$"
    read = lambda p: _month_year(F.regexp_extract(t, p, 1), F.regexp_extract(t, p, 2))
    return F.when(t.rlike(full), read(full)).when(t.rlike(part), read(part))


def period_label(period: Column, month: Column, year: Column) -> Column:
    """A readable label: Month YYYY where the fields give it, with the period's own label before it; never a guessed part."""
    date = F.coalesce(_month_year(month, year), whole_year(year))
    rest = F.nullif(F.concat_ws(" ", F.nullif(month, F.lit("")), F.nullif(year, F.lit(""))), F.lit(""))
    return F.coalesce(embedded_date(period), F.concat(period, F.lit(" "), date), date, period, rest, F.lit("unspecified period"))


def question_text(metric: Column, period: Column) -> Column:
    return F.concat(F.lit("What was "), metric, F.lit(" in "), period, F.lit("?"))


def confirmed_pair(a: Column, b: Column) -> Column:
    """Whether the page's reading confirms both sides of a pair."""
    return F.coalesce(a.isin(*CONFIRMED) & b.isin(*CONFIRMED), F.lit(False))


def typed_union(**pairs: DataFrame) -> DataFrame:
    """The union of pair tables, each row with its table's name as pair_type."""
    out = None
    for name, df in pairs.items():
        df = df.withColumn("pair_type", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out


def instance_questions(pairs: DataFrame, instances: DataFrame, outcomes: DataFrame, flagged: DataFrame) -> DataFrame:
    """Question pairs of instance pairs: a row for each metric that both instances have and the page confirms on both sides.

    pairs(document_id, ordinal_a, ordinal_b, ...), instances(document_id, ordinal, label, values: map),
    outcomes(document_id, ordinal, metric, outcome), flagged(document_id, ordinal): instances that no pair may use.
    """
    i = instances.join(flagged, ["document_id", "ordinal"], "left_anti").select("document_id", "ordinal", "label", F.explode("values").alias("metric", "value"))
    i = i.join(outcomes, ["document_id", "ordinal", "metric"])
    side = lambda s: i.select("document_id", F.col("ordinal").alias(f"ordinal_{s}"), "metric", F.col("label").alias(f"label_{s}"), F.col("value").alias(f"answer_{s}"), F.col("outcome").alias(f"outcome_{s}"))
    j = pairs.join(side("a"), ["document_id", "ordinal_a"]).join(side("b"), ["document_id", "ordinal_b", "metric"])
    j = j.where(confirmed_pair(F.col("outcome_a"), F.col("outcome_b")) & (F.col("answer_a") != F.col("answer_b")))
    return j.select(*pairs.columns, "metric", *(question_text(F.col("metric"), F.col(f"label_{s}")).alias(f"question_{s}") for s in "ab"), "answer_a", "answer_b")


def pair_records(pairs: DataFrame, prefix: str, subset: str, pair_type: str) -> DataFrame:
    """Wide records of fact pairs with template questions, numbered in the order of their table and sides.

    pairs(table_id, unit, rule, and metric, period, value, fact_id of sides a and b).
    """
    side = lambda s: [F.col(f"fact_id_{s}").alias(f"question_{s}_id"), question_text(F.col(f"metric_{s}"), F.col(f"period_{s}")).alias(f"question_{s}"), F.col(f"value_{s}").cast("string").alias(f"answer_{s}"), number_text(F.col(f"value_{s}").cast("string")).alias(f"normalized_answer_{s}"), F.col(f"metric_{s}"), F.col(f"period_{s}"), F.col("unit").alias(f"unit_class_{s}")]
    document = slug(F.col("table_id").cast("string"))
    named = numbered(pairs, prefix, ["table_id", "fact_id_a", "fact_id_b"])
    return named.select("pair_id", F.lit(pair_type).alias("pair_type"), F.lit(subset).alias("subset"), document.alias("document_id"), F.lit(None).cast("string").alias("page_id"), document.alias("table_id"), *side("a"), *side("b"), F.lit(pair_type).alias("changed_dimension"), F.col("rule").alias("construction_rule"), F.lit("deterministic_template").alias("question_generation_method"), F.lit("structurally_valid").alias("validation_status"))


def grounding_examples(records: DataFrame) -> DataFrame:
    """Training examples of valid payloads, and the reason of each other one: (group_id, variant, reason, example).

    records(group_id, variant, question, payload): payload has evidence, evidence_units, answer and image_path.
    """
    e = F.col("payload.evidence")
    text = lambda i: F.get(F.filter("payload.evidence_units", lambda u: u.id == i), F.lit(0)).text
    row, column = text(F.get(e.row_header_ids, F.lit(0))), text(F.get(e.column_header_ids, F.lit(0)))
    box = grid_box(e.bbox_normalised)
    example = F.struct(F.col("payload.image_path").alias("image_path"), "question", F.col("payload.answer.raw").alias("answer"), row.alias("row_header"), column.alias("column_header"), e.target_id.alias("target_id"), box.alias("box"), grounding_target(F.col("payload.answer.raw"), row, column, box).alias("target"))
    checked = records.withColumn("reason", grounding_reason())
    return checked.select("group_id", "variant", "reason", F.when(F.col("reason").isNull(), example).alias("example"))


def gold_overlap(groups: DataFrame) -> DataFrame:
    """(group_id, overlap): groups whose irrelevant edit changes cells of the clean gold evidence. groups(group_id, gold_ids, changed_ids)."""
    return groups.select("group_id", F.array_sort(F.array_intersect("changed_ids", "gold_ids")).alias("overlap")).where(F.size("overlap") > 0)


def answer_target(answer: Column) -> Column:
    """The trimmed answer; a missing or blank one fails."""
    return F.coalesce(F.nullif(F.trim(answer), F.lit("")), F.raise_error(F.lit("a record without an answer")).cast("string"))


def interval_strategy(value: Column, default: str = "no") -> Column:
    """no, steps or epoch from a configured value (true and false as texts included); others fail."""
    t = F.lower(F.trim(value))
    return F.when(value.isNull(), default).when(t == "true", "steps").when(t == "false", "no").when(t.isin("no", "steps", "epoch"), t).otherwise(F.raise_error(F.concat(F.lit("no interval strategy: "), value)).cast("string"))


def of_variants(records: DataFrame, allowed: list[str], variant: str = "variant") -> DataFrame:
    """Records of the allowed variants; a missing or empty variant is clean."""
    return records.where(F.coalesce(F.nullif(F.col(variant), F.lit("")), F.lit("clean")).isin(*allowed))


def required_join(left: DataFrame, right: DataFrame, key: str, value: str, ordinal: str) -> DataFrame:
    """left with the last ``value`` of right by ``ordinal``; a key without one fails."""
    last = right.groupBy(key).agg(F.max_by(value, ordinal).alias(value), F.lit(True).alias("found"))
    j = left.join(last, key, "left")
    bad = F.raise_error(F.concat(F.lit("no match for "), F.col(key).cast("string"))).cast("boolean")
    return j.where(F.coalesce("found", bad)).drop("found")


def first_accepted(rows: DataFrame, by: str, seed: int, key: str) -> DataFrame:
    """One accepted row of each group: the first in the group's seeded digest order. rows(..., accepted)."""
    order = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256)
    w = Window.partitionBy(by).orderBy(order, key)
    return rows.where("accepted").withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def until_accepted(rows: DataFrame, by: str, ordinal: str, limit: int) -> DataFrame:
    """Rows of each group in order until ``limit`` of them are accepted, as a reader that stops early sees them."""
    w = Window.partitionBy(by).orderBy(ordinal).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("__n", F.coalesce(F.sum(F.col("accepted").cast("int")).over(w), F.lit(0))).where(F.col("__n") < limit).drop("__n")
