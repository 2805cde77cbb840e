"""Mining of confusable pairs: deduplicated facts, constrained self-joins, caps, checks, stratified selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import month_number, whole_year, year_gap
from ..functions.text import ACTUAL_LABELS, FORECAST_LABELS, confusable, content_words, first_year, has_qualifier, is_footnote_copy, label_class, strings, temporal_remainder, without_qualifiers
from .ranks import positions
from .shared import bounded, written

# Fixed values.
JACCARD_FROM = 0.5
PER_METRIC, PER_TABLE = 4, 24
COLUMN_APART = 20.0

#: Rows of a block of a group that is paired with itself.
BLOCK_ROWS = 1024


def agreed(facts: DataFrame, key: list[str], value: str, ordinal: str) -> DataFrame:
    """One fact a key, the first by ordinal, for keys whose facts all have one value."""
    rest = [c for c in facts.columns if c not in key]
    kept = facts.groupBy(*key).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"), F.min_by(F.struct(*rest), ordinal).alias("__r"))
    return kept.where(F.col("__lo") == F.col("__hi")).select(*key, "__r.*")


def _self_join(facts: DataFrame, equal: list[str], columns: list[str], before: Column, block: int = BLOCK_ROWS) -> DataFrame:
    """Pairs of rows that agree in ``equal`` and fulfil ``before``, a condition that holds for one order of a pair at most.

    A group of more than ``block`` rows becomes blocks, dealt by digest of its rows, and meets as a triangle: each two blocks, and each
    block with itself, are a tile of their own, so a tile has two blocks of rows at most whatever the group's size.
    """
    rows = facts.select(*columns)
    sizes = written(rows.groupBy(*equal).agg(F.count("*").alias("__n")).where(F.col("__n") > block).select(*equal, F.ceil(F.col("__n") / block).cast("int").alias("__blocks")), "large-groups")
    n = sizes.count()
    side = lambda df, s: df.select(*(F.col(c).alias(c if c in equal or c.startswith("__") and c != "__block" else f"{c}_{s}") for c in df.columns))
    if not n:
        return side(rows, "a").join(side(rows, "b"), equal).where(before)
    dealt = rows.join(bounded(sizes, 64, n), equal, "left").withColumn("__blocks", F.coalesce("__blocks", F.lit(1)))
    dealt = dealt.withColumn("__block", F.pmod(F.xxhash64(*columns), F.col("__blocks")).cast("int")).withColumn("__with", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    tiled = dealt.withColumn("__lo", F.least("__block", "__with")).withColumn("__hi", F.greatest("__block", "__with")).drop("__blocks", "__with")
    met = side(tiled, "a").join(side(tiled, "b"), [*equal, "__lo", "__hi"])
    across = (F.col("__lo") == F.col("__hi")) | (F.col("__block_a") != F.col("__block_b"))
    return met.where(across & before).drop("__lo", "__hi", "__block_a", "__block_b")


def period_pairs(facts: DataFrame, caps: bool = True) -> DataFrame:
    """Pairs of one metric of a table over two periods with other values, in period order.

    facts(table_id, metric, period, unit, value, arrival). Equal unit and equal rest of the period label are join keys; caps
    keep the closest PER_METRIC pairs of a metric and PER_TABLE of a table.
    """
    one = agreed(facts, ["table_id", "metric", "period", "unit"], "value", "arrival")
    one = one.withColumn("rest", temporal_remainder(F.col("period"))).withColumn("year", F.coalesce(first_year(F.col("period")), F.lit(0)))
    order = F.struct("year_a", "period_a") < F.struct("year_b", "period_b")
    pairs = _self_join(one, ["table_id", "metric", "unit", "rest"], ["table_id", "metric", "unit", "rest", "period", "year", "value"], order & (F.col("value_a") != F.col("value_b")))
    pairs = pairs.withColumn("gap", year_gap(F.col("year_a"), F.col("year_b"))).withColumn("rule", F.when(F.col("gap") == 1, "adjacent").otherwise("skip"))
    pairs = pairs.select("table_id", "metric", "unit", "period_a", "period_b", "value_a", "value_b", "gap", "rule")
    if not caps:
        return pairs
    near = [F.col("gap"), F.col("period_a"), F.col("period_b"), F.col("unit")]
    pairs = pairs.withColumn("k", F.row_number().over(Window.partitionBy("table_id", "metric").orderBy(*near))).where(F.col("k") <= PER_METRIC)
    return pairs.withColumn("k", F.row_number().over(Window.partitionBy("table_id").orderBy("gap", "metric", "period_a", "period_b", "unit"))).where(F.col("k") <= PER_TABLE).drop("k")


def metric_pairs(facts: DataFrame) -> DataFrame:
    """Pairs of related metrics of a table in one period, unit and scope (null equal to null) with other values."""
    one = agreed(facts, ["table_id", "metric", "period", "unit", "scope"], "value", "arrival")
    one = written(one.withColumn("scope", F.coalesce(F.concat(F.lit("="), F.col("scope")), F.lit(""))), "agreed-facts")
    related = related_metrics(one.select("metric").distinct())
    keys = ["table_id", "period", "unit", "scope"]
    side = lambda s: one.select(*keys, F.col("metric").alias(f"metric_{s}"), F.col("value").alias(f"value_{s}"))
    j = side("a").join(related, "metric_a").join(side("b"), [*keys, "metric_b"]).where(F.col("value_a") != F.col("value_b"))
    return j.select("table_id", "period", "unit", "metric_a", "metric_b", "value_a", "value_b", F.bround("jaccard", 6).alias("jaccard"), F.when(F.col("basis"), "basis").otherwise("metric").alias("pair_type"), confusable(F.col("metric_a"), F.col("metric_b")).alias("confusable"))


def related_metrics(metrics: DataFrame) -> DataFrame:
    """(metric_a, metric_b, jaccard, basis) of distinct labels that a metric pair may join, found by shared words or one base.

    Labels are few beside facts, so relatedness is settled once a label pair and joined to the facts by equality.
    """
    words, ranked = _ranked_words(metrics)
    found = _candidates(ranked)
    shared = F.size(F.array_intersect("words_a", "words_b"))
    alike = found.where(shared * (1 + JACCARD_FROM) >= (F.col("n_a") + F.col("n_b")) * JACCARD_FROM).select("metric_a", "metric_b", (shared / (F.col("n_a") + F.col("n_b") - shared)).alias("jaccard"), F.lit(False).alias("basis"))
    based = words.select("metric", "words", F.size("words").alias("n"), without_qualifiers(F.col("metric")).alias("base"), has_qualifier(F.col("metric")).alias("q")).where("base <> ''")
    side = lambda s: based.select("base", *(F.col(c).alias(f"{c}_{s}") for c in ("metric", "words", "n", "q")))
    overlap = F.coalesce(F.try_divide(shared, F.col("n_a") + F.col("n_b") - shared), F.lit(0.0))
    basis = side("a").join(side("b"), "base").where("metric_a < metric_b and q_a <> q_b").select("metric_a", "metric_b", overlap.alias("jaccard"), F.lit(True).alias("basis"))
    # pairs that are both are few, and are basis pairs
    only = alike.join(bounded(written(basis.select("metric_a", "metric_b"), "basis-pairs"), 128), ["metric_a", "metric_b"], "left_anti")
    return only.unionByName(basis).where(~is_footnote_copy(F.col("metric_a"), F.col("metric_b")))


def _ranked_words(metrics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(metric, words) of labels, and (metric, words, n) with words as their ranks from rare to common, in that order."""
    words = written(metrics.select("metric", content_words(F.col("metric")).alias("words")), "label-words")
    one = words.select("metric", F.explode("words").alias("word"))
    often = written(one.groupBy("word").agg(F.count("*").alias("often")), "word-counts")
    ranks = bounded(positions(often, ["often", "word"], "rank").select("word", "rank"), 64)
    ranked = one.join(ranks, "word").groupBy("metric").agg(F.array_sort(F.collect_list("rank")).alias("words"))
    return words, ranked.withColumn("n", F.size("words"))


def _candidates(ranked: DataFrame) -> DataFrame:
    """(metric_a, metric_b, words_a, words_b, n_a, n_b): pairs of labels that may share JACCARD_FROM of their words, each once.

    Prefix filter: two labels that share so many words have one in common among their first n - ceil(n * JACCARD_FROM) + 1, from rare
    to common, so common words mostly join nothing. Length and position bound what can still be shared; a pair counts at the first
    word that it shares.
    """
    first = F.col("n") - F.ceil(F.col("n") * JACCARD_FROM) + 1
    prefix = written(ranked.select("metric", "words", "n", F.posexplode(F.slice("words", F.lit(1), first.cast("int"))).alias("at", "word")), "label-prefixes")
    side = lambda s: prefix.select("word", *(F.col(c).alias(f"{c}_{s}") for c in ("metric", "words", "n", "at")))
    long_enough = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * JACCARD_FROM
    rest = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    may = rest * (1 + JACCARD_FROM) >= (F.col("n_a") + F.col("n_b")) * JACCARD_FROM
    before = F.arrays_overlap(F.slice("words_a", F.lit(1), F.col("at_a")), F.slice("words_b", F.lit(1), F.col("at_b")))
    met = side("a").join(side("b"), "word").where((F.col("metric_a") < F.col("metric_b")) & long_enough & may)
    return met.where((F.col("at_a") == 0) | (F.col("at_b") == 0) | ~before).select("metric_a", "metric_b", "words_a", "words_b", "n_a", "n_b")


def similar_candidates(metrics: DataFrame) -> DataFrame:
    """The pairs of labels that related_metrics compares in full."""
    return _candidates(_ranked_words(metrics)[1])


def classify(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Type of a pair of questions of one table, else the first reason against it: basis, period, metric, unit, in order."""
    m, n, p, q = a["metric"], b["metric"], a["period"], b["period"]
    same_metric, same_period = F.coalesce(m == n, F.lit(False)), F.coalesce(p == q, F.lit(False))
    basis = m.isNotNull() & n.isNotNull() & ~same_metric & (without_qualifiers(m) != "") & (without_qualifiers(m) == without_qualifiers(n)) & (has_qualifier(m) != has_qualifier(n)) & (same_period | (p.isNull() & q.isNull()))
    return (
        F.when(a["question"] == b["question"], "rejected_self_pair")
        .when(a["answer"] == b["answer"], "rejected_gold_answers_identical")
        .when(basis, "basis")
        .when(same_metric & p.isNotNull() & q.isNotNull() & ~same_period, "period")
        .when(same_period & m.isNotNull() & n.isNotNull() & ~same_metric, "metric")
        .when(same_metric & same_period & (a["scale"] != "") & (b["scale"] != "") & (a["scale"] != b["scale"]), "unit")
        .when(m.isNull() | n.isNull(), "rejected_metric_ambiguous")
        .when(p.isNull() | q.isNull(), "rejected_period_ambiguous")
        .when(~same_metric & ~same_period, "rejected_more_than_one_dimension_changed")
        .otherwise("rejected_no_matching_rule")
    )


def question_pairs(questions: DataFrame) -> DataFrame:
    """All unordered pairs of a table's questions with their type or reason. questions(table_id, question, metric, period, answer, scale)."""
    columns = ["question", "metric", "period", "answer", "scale"]
    j = _self_join(questions, ["table_id"], ["table_id", *columns], F.col("question_a") < F.col("question_b"))
    side = lambda s: {c: F.col(f"{c}_{s}") for c in columns}
    return j.select("table_id", "question_a", "question_b", classify(side("a"), side("b")).alias("verdict"))


def instance_pairs(instances: DataFrame) -> DataFrame:
    """Every pair of a company's instances in a document, in order of arrival, with its verdict.

    instances(document_id, company, ordinal, period, year, month, column_x). Verdicts: basis, excluded, identical, period.
    """
    one = instances.select("document_id", "company", "ordinal", "period", "column_x", label_class(F.col("period")).alias("kind"), whole_year(F.col("year")).alias("y"), month_number(F.col("month")).alias("m"), F.lower(F.trim("period")).alias("label"))
    j = _self_join(one, ["document_id", "company"], ["document_id", "company", "ordinal", "period", "column_x", "kind", "y", "m", "label"], F.col("ordinal_a") < F.col("ordinal_b"))
    labels = F.array("label_a", "label_b")
    basis = (F.col("y_a") == F.col("y_b")) & F.arrays_overlap(labels, strings(ACTUAL_LABELS)) & F.arrays_overlap(labels, strings(FORECAST_LABELS))
    bad = F.col("kind_a").isin("ambiguous_relative", "scenario_basis") | F.col("kind_b").isin("ambiguous_relative", "scenario_basis") | F.col("y_a").isNull() | F.col("y_b").isNull()
    same = F.struct("y_a", "m_a", "period_a").eqNullSafe(F.struct(F.col("y_b").alias("y_a"), F.col("m_b").alias("m_a"), F.col("period_b").alias("period_a")))
    apart = F.coalesce(F.abs(F.col("column_x_a") - F.col("column_x_b")) > COLUMN_APART, F.lit(False))
    verdict = F.when(F.coalesce(basis, F.lit(False)), "basis").when(bad, "excluded").when(same & ~apart, "identical").otherwise("period")
    return j.select("document_id", "company", "ordinal_a", "ordinal_b", verdict.alias("verdict"))


def pair_checks(pairs: DataFrame) -> DataFrame:
    """Counts of violations of the seven integrity rules over pair records; all rules appear.

    pairs(pair_id, document_a, table_a, question_a, question_b, answer_a, answer_b, evidence_a, evidence_b, pair_type)
    """
    key = F.array_sort(F.array("question_a", "question_b"))
    w = lambda k: F.count("*").over(Window.partitionBy(k))
    flagged = pairs.select(
        (w("pair_id") > 1).alias("duplicate_id"),
        (F.col("question_a") == F.col("question_b")).alias("self_pair"),
        (F.count("*").over(Window.partitionBy(key)) > 1).alias("reversed_duplicate"),
        (F.col("answer_a") == F.col("answer_b")).alias("identical_answers"),
        (F.col("document_a") != F.col("table_a")).alias("document_not_table"),
        (F.col("evidence_a").isNull() | F.col("evidence_b").isNull()).alias("missing_evidence"),
        ~F.col("pair_type").isin("period", "metric", "basis", "unit").alias("bad_type"),
    )
    names = ["duplicate_id", "self_pair", "reversed_duplicate", "identical_answers", "document_not_table", "missing_evidence", "bad_type"]
    flagged = flagged.toDF(*names)
    return flagged.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.coalesce(F.col(n), F.lit(True)).cast("long").alias("hit")) for n in names))).alias("s")).groupBy("s.rule").agg(F.sum("s.hit").alias("violations"))


def numbered(df: DataFrame, prefix: str, order: list[str]) -> DataFrame:
    """pair_id prefix_000000, prefix_000001, … in the given total order."""
    return positions(df, order, "__i").withColumn("pair_id", F.format_string(f"{prefix}_%06d", F.col("__i"))).drop("__i")


def primary_selection(pairs: DataFrame, seed: int, table_cap: int, adjacent: int, skip: int) -> DataFrame:
    """Three stages by seeded digests: one adjacent and one skip pair a metric, table_cap a table, then the targets.

    pairs(pair_id, table_id, metric, rule). The result does not depend on the order of the input.
    """
    draw = lambda stage: F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit(stage), F.col("pair_id")), 256)
    pick = lambda df, by, stage, n: df.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(draw(stage), "pair_id"))).where(F.col("__k") <= n).drop("__k")
    kept = pick(pairs.where(F.col("rule").isin("adjacent", "skip")), ["table_id", "metric", "rule"], "metric", 1)
    kept = pick(kept, ["table_id"], "table", table_cap)
    last = lambda rule, n: kept.where(F.col("rule") == rule).orderBy(draw("all"), "pair_id").limit(n)
    return last("adjacent", adjacent).unionByName(last("skip", skip))
