"""Grouped accuracy, conditional probabilities, pair metrics, error taxonomy and report statistics.

Every metric is a pair of sums (numerator, denominator), so that partial aggregates combine before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import geometric_mean, rate
from ..functions.text import canonical_variant
from .ranks import tallied, value_at

COUNTERFACTUALS = ("target_value", "header_address_swap", "irrelevant_value")
VARIANTS = ("clean", *COUNTERFACTUALS)


def sets(df: DataFrame, groupings: list[tuple[str, ...]], *aggs: Column) -> DataFrame:
    """Aggregates over grouping sets in one pass; columns out of a set are null, ``level`` counts those in it."""
    columns = list(dict.fromkeys(c for g in groupings for c in g))
    level = sum((1 - F.grouping(c)).cast("int") for c in columns)
    return df.groupingSets([[F.col(c) for c in g] for g in groupings], *columns).agg(level.alias("level"), *aggs)


def accuracy(predictions: DataFrame) -> DataFrame:
    """Totals and rates overall, by setting, and by setting and canonical variant; rates are 0 on none."""
    p = predictions.withColumn("variant", canonical_variant(F.col("variant")))
    share = lambda c: F.coalesce(rate(F.count_if(c), F.count("*")), F.lit(0.0))
    return sets(p, [(), ("setting",), ("setting", "variant")], F.count("*").alias("total"), F.count_if("exact").alias("exact_correct"), F.count_if("numeric").alias("numeric_correct"), share("exact").alias("exact_accuracy"), share("numeric").alias("numeric_accuracy"))


def prediction_summary(predictions: DataFrame) -> DataFrame:
    """Totals by setting and by setting and scale ("none" where missing), from the stored flags."""
    p = predictions.withColumn("scale", F.coalesce(F.nullif(F.col("scale"), F.lit("")), F.lit("none")))
    return sets(p, [(), ("setting",), ("setting", "scale")], F.count("*").alias("total"), F.count_if("exact").alias("exact_correct"), F.count_if("numeric").alias("numeric_correct"))


def counterfactual_scores(predictions: DataFrame, flag: str = "exact") -> DataFrame:
    """Per setting: clean accuracy, the three counterfactual rates, and their geometric mean; null where a variant is missing."""
    p = predictions.withColumn("variant", canonical_variant(F.col("variant")))
    by = [rate(F.count_if((F.col("variant") == v) & F.col(flag)), F.count_if(F.col("variant") == v)).alias(n) for v, n in zip(VARIANTS, ("clean", "tvfr", "hfr", "isr"), strict=True)]
    return p.groupBy("setting").agg(*by).withColumn("cgs", geometric_mean(F.col("tvfr"), F.col("hfr"), F.col("isr")))


def group_predictions(predictions: DataFrame, flag: str = "exact") -> DataFrame:
    """(setting, group) by variant: the first prediction of each by ordinal, and how many later ones there were."""
    p = predictions.withColumn("variant", canonical_variant(F.col("variant"))).where(F.col("variant").isin(*VARIANTS) & F.col("group_id").isNotNull())
    first = p.groupBy("setting", "group_id", "variant").agg(F.min_by(flag, "ordinal").alias("correct"), (F.count("*") - 1).alias("again"))
    return first.groupBy("setting", "group_id").agg(*(F.max(F.when(F.col("variant") == v, F.col("correct"))).alias(v) for v in VARIANTS), F.sum("again").alias("duplicates"))


def conditional_probabilities(grouped: DataFrame) -> DataFrame:
    """Over complete groups with a right clean answer: how often each counterfactual fails, and the differences."""
    complete = F.lit(True)
    for v in VARIANTS:
        complete = complete & F.col(v).isNotNull()
    base = complete & F.col("clean")
    p = lambda c: rate(F.count_if(base & c), F.count_if(base))
    t, h, i = ~F.col("target_value"), ~F.col("header_address_swap"), ~F.col("irrelevant_value")
    out = grouped.groupBy("setting").agg(F.count_if(complete).alias("complete_groups"), F.count_if(base).alias("clean_correct_groups"), p(t).alias("p_t0"), p(h).alias("p_h0"), p(t | h).alias("p_t0_or_h0"), p(i).alias("p_i0"))
    for name in ("p_t0", "p_h0", "p_t0_or_h0"):
        out = out.withColumn(f"{name}_minus_i0", F.col(name) - F.col("p_i0")).withColumn(f"{name}_exceeds_i0", F.col(name) > F.col("p_i0"))
    return out


def grounding(rows: DataFrame) -> DataFrame:
    """Per variant: row, column and cell accuracy, mean and median overlap, joint and conditional cell rates."""
    cell = F.col("row_ok") & F.col("column_ok")
    return rows.groupBy("variant").agg(F.count("*").alias("n"), rate(F.count_if("row_ok"), F.count("*")).alias("row_accuracy"), rate(F.count_if("column_ok"), F.count("*")).alias("column_accuracy"), rate(F.count_if(cell), F.count("*")).alias("cell_accuracy"), F.avg("iou").alias("mean_iou"), F.median("iou").alias("median_iou"), rate(F.count_if(F.col("answer_ok") & cell), F.count("*")).alias("p_answer_and_cell"), rate(F.count_if(F.col("answer_ok") & cell), F.count_if("answer_ok")).alias("p_cell_given_answer"))


def confusion(rows: DataFrame) -> DataFrame:
    """Per variant: the 2 by 2 counts of right evidence and right answer, and the four conditional rates."""
    e, a = F.coalesce(F.col("evidence_ok"), F.lit(False)), F.coalesce(F.col("answer_ok"), F.lit(False))
    n = lambda c: F.count_if(c)
    return rows.groupBy("variant").agg(n(e & a).alias("both"), n(e & ~a).alias("evidence_only"), n(~e & a).alias("answer_only"), n(~e & ~a).alias("neither"), rate(n(e & a), n(e)).alias("p_answer_given_evidence"), rate(n(~e & a), n(~e)).alias("p_answer_given_no_evidence"), rate(n(e & a), n(a)).alias("p_evidence_given_answer"), rate(n(e & ~a), n(~a)).alias("p_evidence_given_no_answer"))


def error_buckets(rows: DataFrame, variant: str) -> DataFrame:
    """Wrong or right by place and answer for one variant: A both right, B place only, C answer only, D neither."""
    return error_groups(rows, variant).groupBy("bucket").agg(F.count("*").alias("n"), F.min("group_id").alias("first_group"), F.max("group_id").alias("last_group"))


def error_groups(rows: DataFrame, variant: str) -> DataFrame:
    """The groups of the error buckets of one variant, a row each."""
    e, a = F.col("evidence_ok"), F.col("answer_ok")
    bucket = F.when(e & a, "A").when(e, "B").when(a, "C").otherwise("D")
    return rows.where(F.col("variant") == variant).select(bucket.alias("bucket"), "group_id")


def pair_sums() -> dict[str, tuple[Column, Column]]:
    """Numerator and denominator of every pair metric over outcomes."""
    a, b, ca, cb = (F.col(c) for c in ("correct_a", "correct_b", "a_captured", "b_captured"))
    n, both = F.count("*"), F.count_if
    return {
        "individual_accuracy": (both(a) + both(b), n * 2),
        "pair_accuracy": (both(a & b), n),
        "capture_rate": (both(ca) + both(cb), n * 2),
        "collapsed_rate": (both(F.col("collapsed")), n),
        "conditional_capture": (both(a & cb) + both(b & ca), both(a & ~b) + both(b & ~a)),
        "semantic_switch": (n - both(F.col("collapsed")), n),
    }


def pair_metrics(outcomes: DataFrame, *by: str) -> DataFrame:
    return outcomes.groupBy(*by).agg(F.count("*").alias("pairs"), *(rate(x, y).alias(k) for k, (x, y) in pair_sums().items()))


def table_macro(outcomes: DataFrame) -> DataFrame:
    """Means over tables of each table's pair metrics; tables without a value do not count."""
    return pair_metrics(outcomes, "table_id").agg(F.count("*").alias("tables"), *(F.avg(k).alias(k) for k in pair_sums()))


MODES = ("captured", "scale_shift", "other_cell", "unexplained")


def error_taxonomy(sides: DataFrame) -> DataFrame:
    """Counts of wrong sides by the first mode that fits; all modes appear. sides(correct, captured, scale_shift, other_cell)."""
    mode = F.when(F.col("captured"), MODES[0]).when(F.col("scale_shift"), MODES[1]).when(F.col("other_cell"), MODES[2]).otherwise(MODES[3])
    wrong = sides.where(~F.col("correct"))
    return wrong.select(F.explode(F.array(*(F.struct(F.lit(m).alias("mode"), (mode == m).cast("long").alias("hit")) for m in MODES))).alias("s")).groupBy("s.mode").agg(F.sum("s.hit").alias("n"))


def pair_sides(outcomes: DataFrame) -> DataFrame:
    """One row a side: pair_id, table_id, side, correct, captured."""
    return outcomes.select("pair_id", "table_id", "document_id", "n", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("correct_a").alias("correct"), F.col("a_captured").alias("captured")), F.struct(F.lit("b").alias("side"), F.col("correct_b").alias("correct"), F.col("b_captured").alias("captured")))).alias("s")).select("pair_id", "table_id", "document_id", "n", "s.*")


def joined_outcomes(base: DataFrame, other: DataFrame) -> DataFrame:
    """(pair_id, base, other): whether a pair is right under each of two checkpoints; pairs that both have. Inputs: pair_id, correct."""
    return base.select("pair_id", F.col("correct").alias("base")).join(other.select("pair_id", F.col("correct").alias("other")), "pair_id")


def rescue_regression(base: DataFrame, other: DataFrame) -> DataFrame:
    """2 by 2 counts of two checkpoints' pair results by pair_id, rescue and regression rates. Inputs: pair_id, correct."""
    x, y, n = F.col("base"), F.col("other"), F.count_if
    return joined_outcomes(base, other).agg(n(x & y).alias("both"), n(x & ~y).alias("lost"), n(~x & y).alias("rescued"), n(~x & ~y).alias("neither"), rate(n(~x & y), n(~x)).alias("rescue_rate"), rate(n(x & ~y), n(x)).alias("regression_rate"))


def mean_sd(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Mean and sample deviation of what is not null: 0 for one value, null for none."""
    n = F.count(value)
    return df.groupBy(*by).agg(n.alias("n"), F.avg(value).alias("mean"), F.when(n == 1, F.lit(0.0)).when(n > 1, F.stddev_samp(value)).alias("sd"))


def table_values(sides: DataFrame) -> DataFrame:
    """(table_id, value) of all gold values."""
    return sides.select("table_id", F.col("gold").alias("value")).where("value is not null").distinct()


def other_cell_rate(sides: DataFrame) -> DataFrame:
    """Among wrong sides that no other mode explains: how often the prediction is another gold value of its table."""
    rest = sides.where(~F.col("correct") & ~F.col("captured"))
    known = table_values(sides).select("table_id", F.col("value").alias("predicted"), F.lit(1).alias("hit"))
    hit = rest.join(known, ["table_id", "predicted"], "left")
    return hit.agg(F.count("*").alias("items"), F.count("hit").alias("hits"), rate(F.count("hit"), F.count("*")).alias("rate"))


def last_wins(df: DataFrame, key: list[str], ordinal: str) -> DataFrame:
    """The last row of each key by ordinal."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), ordinal).alias("r")).select(*key, "r.*")


def first_wins(df: DataFrame, key: list[str], ordinal: str) -> DataFrame:
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), ordinal).alias("r")).select(*key, "r.*")


def coverage(pairs: DataFrame, table: str = "table_id") -> DataFrame:
    """Pairs per table: tables, pairs, median, maximum, and quartiles by index."""
    per = pairs.groupBy(table).agg(F.count("*").alias("n"))
    last = F.col("total") - 1
    middle = (value_at("n", F.floor(last / 2)) + value_at("n", F.ceil(last / 2))) / 2
    quartiles = (value_at("n", F.floor(F.lit(p) * last)).alias(k) for p, k in ((0.25, "p25"), (0.75, "p75")))
    return tallied(per, "n").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("tables"), F.sum(F.col("n") * F.col("c")).alias("pairs"), middle.alias("median"), F.max("n").alias("most"), *quartiles)


def per_document(pairs: DataFrame, document: str) -> DataFrame:
    """Minimum, maximum, mean and upper median of pairs a document."""
    per = pairs.groupBy(document).agg(F.count("*").alias("n"))
    mean = F.sum(F.col("n") * F.col("c")) / F.sum("c")
    return tallied(per, "n").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.bround(mean, 3).alias("mean"), value_at("n", F.floor(F.col("total") / 2)).alias("upper_median"))


def top(df: DataFrame, key: str, k: int = 10) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(k)


def funnel(rows: DataFrame) -> DataFrame:
    """Counts by reason, in all and by split."""
    return sets(rows, [("reason",), ("split", "reason")], F.count("*").alias("n"))


def cycle_coverage(visits: DataFrame, kinds: list[str]) -> DataFrame:
    """Per cycle: groups, groups that saw each kind exactly once, and visits beyond the first."""
    per = visits.groupBy("cycle", "group_id").agg(F.sort_array(F.collect_list("kind")).alias("seen"), (F.count("*") - F.count_distinct("kind")).alias("again"))
    return per.groupBy("cycle").agg(F.count("*").alias("groups"), F.count_if(F.col("seen") == F.array(*map(F.lit, sorted(kinds)))).alias("covered"), F.sum("again").alias("duplicates"))


def decision(scores: DataFrame) -> DataFrame:
    """Case A, B or C of a method against its reference: A gains without losing clean accuracy, B keeps level, C the rest."""
    gain, loss = F.col("cgs") - F.col("ref_cgs"), F.col("ref_clean") - F.col("clean")
    return scores.withColumn("case", F.when((gain > 0) & (loss <= 0.02), "A").when((gain >= -0.01) & (loss <= 0.02), "B").otherwise("C"))


def significant(deltas: DataFrame, *by: str) -> DataFrame:
    """Whether every seed's interval lies above 0 and the mean capture delta does not rise; none counts as not."""
    return deltas.groupBy(*by).agg(F.count("*").alias("seeds"), F.avg("delta").alias("mean_delta"), F.coalesce(F.bool_and(F.coalesce(F.col("ci_low") > 0, F.lit(False))), F.lit(False)).alias("significant"), (F.coalesce(F.avg("capture_delta"), F.lit(0.0)) <= 0).alias("capture_no_worse"))


def dense_prefix(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows of the first n keys in sorted order. The keys alone are ranked, by top-n, and joined back."""
    return df.join(df.select(key).distinct().orderBy(key).limit(n), key, "left_semi")


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
