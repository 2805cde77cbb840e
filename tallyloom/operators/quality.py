"""Data quality: two-sided comparison, completeness, spatial joins with OCR tokens, column clusters, row gaps."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from ..functions.dates import values_match
from ..functions.numbers import ocr_value, rate, scale_or_sign
from ..functions.text import normal
from .inside import PATTERNS, SAME, SCALED, alike, holding, mark, sums_inside
from .metrics import sets
from .scan import HOT_ROWS, in_ranges, same_key, split_hot, with_previous, with_running
from .shared import bounded, written

# Fixed values.
MARGIN = 8
TOKEN = StructType([StructField("x", IntegerType()), StructField("ordinal", LongType()), StructField("text", StringType()), StructField("confidence", IntegerType())])
#: Pairs of fields and tokens in a block, fields in one, and pairs looked at in one go.
PAIRS, ROWS, AT_ONCE = 1 << 26, 256, 1 << 20
#: Fields and tokens of a page that meet in a task where only outcomes are asked for.
FIELDS, TOKENS = 1 << 15, 1 << 17
#: Counts over the tokens near a field: with a text, with a word, with a confidence, sum of confidences, ends in a comma, begins with a digit.
COUNTS = ("seen", "worded", "sure", "total", "commas", "digits")
LOW_CONFIDENCE = 60
NUMERIC = ("monetary", "numerical")
CLUSTER_GAP = 20.0
GAP_RATIO, LEAST_ROWS = 2.5, 3
STATUSES = ("match", "mismatch", "scale_mismatch", "granularity_mismatch", "unparseable")


def two_sided(left: DataFrame, right: DataFrame, key: list[str], ordinal: str) -> DataFrame:
    """Full outer match of the first row of each side per key; the others of a key count as unmatched."""
    one = lambda df, s: df.groupBy(*key).agg(F.count("*").alias(f"n_{s}"), F.min_by(F.struct(*(c for c in df.columns if c not in key)), ordinal).alias(s))
    j = one(left, "left").join(one(right, "right"), key, "full")
    both = F.col("left").isNotNull() & F.col("right").isNotNull()
    spare = lambda s: F.coalesce(F.col(f"n_{s}"), F.lit(0)) - both.cast("int")
    return j.select(*key, "left", "right", both.alias("matched"), spare("left").alias("unmatched_left"), spare("right").alias("unmatched_right"))


def compare_fields(matched: DataFrame, mapping: DataFrame, key: list[str]) -> DataFrame:
    """One row a compared field: field, status. matched(left_values, right_values: maps), mapping(left_field, right_field, kind).

    The mapping is a fixed small table, so it is broadcast; a field counts where both sides have a value.
    """
    a = matched.select(*key, F.explode("left_values").alias("left_field", "a"), "right_values")
    j = a.join(F.broadcast(mapping), "left_field").withColumn("b", F.try_element_at("right_values", F.col("right_field")))
    return j.where((F.col("a") != "") & (F.col("b") != "")).select(*key, F.col("left_field").alias("field"), values_match(F.col("kind"), F.col("a"), F.col("b")).alias("status"))


def audit_summary(comparisons: DataFrame) -> DataFrame:
    """Counts of each status a field; mismatch rate over match and mismatch, the other rates over all comparisons."""
    n = {s: F.count_if(F.col("status") == s) for s in STATUSES}
    out = comparisons.groupBy("field").agg(F.count("*").alias("compared"), *(n[s].alias(s) for s in STATUSES))
    return out.withColumn("mismatch_rate", rate(F.col("mismatch"), F.col("match") + F.col("mismatch"))).withColumn("scale_rate", rate(F.col("scale_mismatch"), F.col("compared"))).withColumn("granularity_rate", rate(F.col("granularity_mismatch"), F.col("compared")))


def completeness(instances: DataFrame, fields: list[str], values: str = "values") -> DataFrame:
    """Present, total and rate of each listed field and of all together; 0 on none."""
    present = [F.count_if(F.coalesce(F.trim(F.try_element_at(values, F.lit(f))), F.lit("")) != "").alias(f) for f in fields]
    one = instances.agg(F.count("*").alias("total"), *present)
    per = one.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("present"), F.col("total")) for f in fields))).alias("s")).select("s.*")
    return sets(per, [(), ("field",)], F.sum("present").alias("present"), F.sum("total").alias("total"), F.coalesce(rate(F.sum("present"), F.sum("total")), F.lit(0.0)).alias("rate"))


def tokens_near(fields: DataFrame, tokens: DataFrame, margin: int = MARGIN) -> DataFrame:
    """Each field with the tokens of its page whose centre lies in its box, widened by margin, ordered by left and ordinal.

    fields(field_id, page, top, left, bottom, right, ...), tokens(page, top, left, bottom, right, ordinal, text, confidence).
    A page's fields are dealt into blocks that meet its tokens, PAIRS at a time; fields and tokens are shuffled, what is near is not.
    """
    found = StructType([*fields.schema.fields, StructField("near", ArrayType(TOKEN))])
    schema = to_arrow_schema(found)
    near_type, names = schema.field("near").type, fields.columns

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        boxes = table.column("f").combine_chunks().drop_null()
        t = table.filter(pc.is_valid(table.column("t"))).select(["cy", "cx", "t"]).combine_chunks().flatten()
        t = t.sort_by([(f"t.{n}", "ascending") for n in ("x", "ordinal", "text", "confidence")])
        rows = pa.StructArray.from_arrays([t.column(f"t.{n.name}").combine_chunks() for n in near_type.value_type], fields=list(near_type.value_type))
        cy, cx = (t.column(c).to_numpy() for c in ("cy", "cx"))
        top, left, bottom, right = (boxes.field(n).cast(pa.float64()).to_numpy(zero_copy_only=False)[:, None] for n in ("top", "left", "bottom", "right"))
        step = max(1, AT_ONCE // max(1, len(rows)))
        for i in range(0, len(boxes), step):
            s = slice(i, i + step)
            inside = (cy >= top[s] - margin) & (cy <= bottom[s] + margin) & (cx >= left[s] - margin) & (cx <= right[s] + margin)
            ends = np.concatenate([[0], np.cumsum(inside.sum(1))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), rows.take(pa.array(np.nonzero(inside)[1])))
            part = boxes.slice(i, step)
            yield pa.RecordBatch.from_arrays([*(part.field(n).cast(schema.field(n).type) for n in names), lists.cast(near_type)], schema=schema)

    t = tokens.where(F.col("page").isNotNull()).select("page", ((F.col("top") + F.col("bottom")) / 2).cast("double").alias("cy"), ((F.col("left") + F.col("right")) / 2).cast("double").alias("cx"), F.struct(F.col("left").alias("x"), "ordinal", "text", "confidence").cast(TOKEN).alias("t"))
    n = fields.where(F.col("page").isNotNull()).groupBy("page").agg(F.count("*").alias("n")).join(tokens.groupBy("page").agg(F.count("*").alias("m")), "page", "left")
    blocks = n.select("page", F.ceil(F.greatest(F.col("n") * F.coalesce("m", F.lit(0)) / PAIRS, F.col("n") / ROWS)).cast("int").alias("blocks"))
    f = fields.select("page", F.struct(*fields.columns).alias("f")).join(blocks, "page").withColumn("block", F.pmod(F.xxhash64("f.field_id"), F.col("blocks")).cast("int"))
    t = t.join(blocks, "page").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    both = f.select("page", "block", "f").unionByName(t.select("page", "block", "cy", "cx", "t"), allowMissingColumns=True)
    tasks = int(fields.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a fixed count: small inputs make large lists
    placed = both.repartition(tasks, "page", "block").groupBy("page", "block").applyInArrow(meet, found)
    return placed.unionByName(fields.where(F.col("page").isNull()).withColumn("near", F.array().cast(ArrayType(TOKEN))))


def ocr_numbers(c: Column) -> Column:
    """Readings of all numbers of a text; a comma and blanks before a digit belong inside a number."""
    digits = F.regexp_replace(c, r",\s+(\d)", ",$1")
    return F.filter(F.transform(F.regexp_extract_all(digits, F.lit(r"[-+]?[\d,]*\.?\d+"), F.lit(0)), ocr_value), lambda n: n.isNotNull())


def ocr_outcome(value: Column, kind: Column, near: Column) -> Column:
    """How a field's value agrees with the tokens near it (seven outcomes)."""
    joined = F.array_join(F.transform(near, lambda t: t.text), " ")
    sure = F.filter(F.transform(near, lambda t: t.confidence), lambda c: c.isNotNull())
    mean = F.try_divide(F.aggregate(sure, F.lit(0).cast("bigint"), lambda a, c: a + c).cast("double"), F.size(sure))
    bad = F.when(F.coalesce(mean < LOW_CONFIDENCE, F.lit(False)), "mismatch_low_ocr_confidence").otherwise("mismatch")
    found = ocr_numbers(joined)
    target = ocr_value(value)
    number = F.when(target.isNull(), "annotation_unparseable").when(F.exists(found, lambda n: F.abs(n - target) < 0.5), "match").when(F.exists(found, lambda n: scale_or_sign(target, n)), "match_scale_or_sign").otherwise(bad)
    a, b = normal(value), normal(joined)
    words = F.filter(F.split(a, " "), lambda w: w != "")
    text = F.when((a != "") & (F.contains(b, a) | F.contains(a, b)), "match").when((F.size(words) > 0) & (F.size(F.array_except(words, F.split(b, " "))) == 0), "match_word_set").otherwise(bad)
    return F.when(F.trim(joined) == "", "no_ocr_nearby").when(kind.isin(*NUMERIC), number).otherwise(text)


def _words(c: Column) -> Column:
    return F.filter(F.split(normal(c), " "), lambda w: w != "")


def _looked_up(fields: DataFrame, tokens: DataFrame, margin: int) -> DataFrame:
    """Struct f of each field with a page, COUNTS of the tokens near it, and as bits of hits which numbers or words are among them.

    Blocks of a page's fields meet parts of its tokens, and what the parts give is added up; equal fields are one row, in copies.
    """
    schema = StructType([StructField("f", fields.schema), StructField("parts", IntegerType()), *(StructField(c, LongType()) for c in ("hits", *COUNTS))])
    arrow = to_arrow_schema(schema)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        f, t = (table.filter(test(table.column("f"))).combine_chunks() for test in (pc.is_valid, pc.is_null))
        box = np.stack([f.column(c).to_numpy() for c in ("top", "left", "bottom", "right")])
        ys, xs = (t.column(c).to_numpy() for c in ("cy", "cx"))
        one = np.zeros(max(len(f), len(t)), np.int64)
        counts = sums_inside(one[: len(t)], xs, ys, np.stack([t.column(c).to_numpy() for c in COUNTS]), one[: len(f)], box)
        hits = np.zeros(len(f), np.int64)
        for c in ("numbers", "words"):
            lists = t.column(c).combine_chunks()
            each = lists.flatten().dictionary_encode()
            at, known = pc.list_parent_indices(lists).to_numpy(), each.dictionary.to_pylist()
            keys = each.indices.to_numpy().astype(np.int64)
            if c == "numbers":
                order = np.argsort(known)
                keys, pairs = np.argsort(order)[keys], alike(f.column("target").to_numpy(), np.array(known, float)[order])
            else:
                pairs = holding(f.column("wanted").to_pylist(), known)
            mark(hits, pairs, keys, xs[at], ys[at], box)
        columns = [f.column("f").combine_chunks().cast(arrow.field("f").type), f.column("parts").combine_chunks(), pa.array(hits), *map(pa.array, counts)]
        yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    text, number = F.col("text"), F.coalesce(F.col("kind").isin(*NUMERIC), F.lit(False))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("bigint")
    none = lambda of: F.array().cast(f"array<{of}>")
    count = (flag(F.trim(text) != ""), flag(F.size(_words(text)) > 0), flag(F.col("confidence").isNotNull()), F.coalesce(F.col("confidence").cast("bigint"), F.lit(0)), flag(text.rlike(r",\s*\z")), flag(text.rlike(r"^\s*\d")))
    t = tokens.where(F.col("page").isNotNull()).select("page", ((F.col("top") + F.col("bottom")) / 2).cast("double").alias("cy"), ((F.col("left") + F.col("right")) / 2).cast("double").alias("cx"), F.xxhash64(*tokens.columns).alias("hash"), *(c.alias(n) for c, n in zip(count, COUNTS, strict=True)), F.coalesce(ocr_numbers(text), none("double")).alias("numbers"), F.array_distinct(_words(text)).alias("words"))
    t = t.where(F.col("cy").isNotNull() & F.col("cx").isNotNull() & ~F.isnan("cy") & ~F.isnan("cx"))
    edge = lambda c, by: (F.col(c).cast("double") + by).alias(c)
    f = fields.where(F.col("page").isNotNull()).select("page", F.struct(*fields.columns).alias("f"), edge("top", -margin), edge("left", -margin), edge("bottom", margin), edge("right", margin), F.when(number, ocr_value(F.col("value"))).alias("target"), F.when(number, none("string")).otherwise(_words(F.col("value"))).alias("wanted"))
    per = f.groupBy("page").agg(F.count("*").alias("n")).join(t.groupBy("page").agg(F.count("*").alias("m")), "page", "left")
    per = per.select("page", F.ceil(F.col("n") / FIELDS).cast("int").alias("blocks"), F.greatest(F.ceil(F.col("m") / TOKENS), F.lit(1)).cast("int").alias("parts"))
    f = f.join(per, "page").withColumn("block", F.pmod(F.xxhash64("f"), F.col("blocks")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    t = t.join(per, "page").withColumn("part", F.pmod(F.col("hash"), F.col("parts")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    both = f.drop("blocks").unionByName(t.drop("blocks", "parts", "hash"), allowMissingColumns=True)
    tasks = int(fields.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a fixed count: small inputs take long
    met = both.repartition(tasks, "page", "block", "part").groupBy("page", "block", "part").applyInArrow(meet, schema)
    copies = (F.count("*") / F.first("parts")).cast("bigint")
    summed = met.groupBy("f").agg(copies.alias("copies"), F.bit_or("hits").alias("hits"), *(F.sum(c).alias(c) for c in COUNTS))
    return summed.select("f", "copies", "hits", *((F.col(c) / F.col("copies")).cast("bigint").alias(c) for c in COUNTS))


def ocr_outcomes(fields: DataFrame, tokens: DataFrame, margin: int = MARGIN) -> DataFrame:
    """fields with the outcome of ``ocr_outcome`` over their ``tokens_near``, of which lists are made only where they are needed.

    fields(field_id, page, top, left, bottom, right, value, kind, ...), tokens as for ``tokens_near``. Counts, and whether some
    number or word is near, come from sums over the tokens inside a box, without looking at each. Where a number or a text may
    span tokens, or so few words are near that all may stand in the value, the field's list decides.
    """
    x = _looked_up(fields, tokens, margin).withColumn("a", normal(F.col("f.value"))).withColumn("n", F.size(_words(F.col("a"))))
    mean = F.try_divide(F.col("total").cast("double"), F.col("sure"))
    bad = F.when(F.coalesce(mean < LOW_CONFIDENCE, F.lit(False)), "mismatch_low_ocr_confidence").otherwise("mismatch")
    has = lambda bits: F.col("hits").bitwiseAND(bits) == bits
    number = F.when(ocr_value(F.col("f.value")).isNull(), "annotation_unparseable").when((F.col("commas") > 0) & (F.col("digits") > 0), None).when(has(F.lit(SAME)), "match").when(has(F.lit(SCALED)), "match_scale_or_sign").otherwise(bad)
    every = F.expr(f"shiftleft(1L, least(n, {PATTERNS})) - 1")
    # the words near a field and the blanks between them are as long as the value at most
    few = F.col("worded") * 2 - 1 <= F.length("a")
    text = F.when(F.col("n") == 0, bad).when((F.col("n") == 1) & has(every), "match").when(few | has(every), None).otherwise(bad)
    outcome = F.when(F.col("seen") == 0, "no_ocr_nearby").when(F.col("f.kind").isin(*NUMERIC), number).otherwise(text)
    known = written(x.select("f", "copies", outcome.alias("outcome")), "outcomes")
    rows = known.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).select("f.*", "outcome")
    listed = tokens_near(rows.where("outcome is null").drop("outcome"), tokens, margin)
    listed = listed.select(*fields.columns, ocr_outcome(F.col("value"), F.col("kind"), F.col("near")).alias("outcome"))
    return rows.where("outcome is not null").unionByName(listed).unionByName(fields.where(F.col("page").isNull()).withColumn("outcome", F.lit("no_ocr_nearby")))


def outcome_summary(outcomes: DataFrame) -> DataFrame:
    """Counts and shares of outcomes over all fields and by field."""
    counts = sets(outcomes, [("outcome",), ("field", "outcome")], F.count("*").alias("n"))
    return counts.withColumn("share", rate(F.col("n"), F.sum("n").over(Window.partitionBy("field"))))


def column_clusters(rows: DataFrame, by: list[str], x: str, ordinal: str, gap: float = CLUSTER_GAP, hot: int = HOT_ROWS) -> DataFrame:
    """Rows with a cluster number by place: a step of more than gap starts a new one; rows without a place are one (-1).

    Groups of more than ``hot`` rows are scanned in ranges, so none of any size lies in one task.
    """
    starts = lambda before: F.coalesce((F.col(x) - before > gap).cast("int"), F.lit(0))
    number = lambda c: F.when(F.col(x).isNull(), F.lit(-1)).otherwise(c)
    few, many = split_hot(rows, by, hot)
    w = Window.partitionBy(*by).orderBy(F.col(x).asc_nulls_last(), ordinal)
    out = few.withColumn("__s", starts(F.lag(x).over(w))).withColumn("cluster", number(F.sum("__s").over(w))).drop("__s")
    if many is None:
        return out
    stepped = with_previous(in_ranges(many, by, [F.col(x).asc_nulls_last(), F.col(ordinal)]), by, x, "__before")
    counted = with_running(stepped, by, starts(F.col("__before")), "__c")
    return out.unionByName(counted.withColumn("cluster", number(F.col("__c"))).select(*out.columns))


def cluster_agreement(clustered: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Agreeing and disagreeing clusters a metric, over clusters with two or more values of it."""
    long = clustered.select(*by, "cluster", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("string").alias("value")) for m in metrics))).alias("s")).select(*by, "cluster", "s.*")
    per = long.where("value is not null").groupBy(*by, "cluster", "metric").agg(F.count("*").alias("n"), F.count_distinct("value").alias("d")).where("n > 1")
    return per.groupBy("metric").agg(F.count_if(F.col("d") == 1).alias("agree"), F.count_if(F.col("d") > 1).alias("disagree"))


def disagreeing(clustered: DataFrame, by: list[str], metric: str, ordinal: str) -> DataFrame:
    """Rows of clusters that hold more than one value of the metric."""
    w = Window.partitionBy(*by, "cluster")
    flagged = clustered.withColumn("__lo", F.min(metric).over(w)).withColumn("__hi", F.max(metric).over(w))
    return flagged.where(F.col("__lo") != F.col("__hi")).select(*by, ordinal).distinct()


def co_occurrence(instances: DataFrame, pairs: list[tuple[str, str]], values: str = "values") -> DataFrame:
    """Instances that have both fields of each listed pair; zeros stay."""
    has = lambda f: F.coalesce(F.array_contains(F.map_keys(values), f), F.lit(False))
    one = instances.agg(*(F.count_if(has(a) & has(b)).alias(f"p{i}") for i, (a, b) in enumerate(pairs)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"p{i}").alias("n")) for i, (a, b) in enumerate(pairs)))).alias("s")).select("s.*")


def _gaps_in_ranges(rows: DataFrame, by: list[str], centre: str, ordinal: str) -> DataFrame:
    """by, rows, largest, after_row, median_other of groups of any size: gaps and their ranks by scans, the median by its ranks."""
    placed = with_running(with_previous(in_ranges(rows, by, [F.col(centre), F.col(ordinal)]), by, centre, "__before"), by, F.lit(1), "__i")
    gaps = written(placed.select(*by, (F.col(centre) - F.col("__before")).alias("gap"), (F.col("__i") - 1).alias("i")), "gaps")
    top = F.max(F.struct("gap", (-F.col("i")).alias("i")))
    per = gaps.groupBy(*by).agg(F.count("*").alias("rows"), top.alias("t")).select(*by, "rows", F.col("t.gap").alias("largest"), F.when(F.col("t.gap").isNotNull(), -F.col("t.i")).cast("int").alias("after_row"))
    ranked = with_running(in_ranges(gaps.where("gap is not null"), by, [F.col("gap"), F.col("i")]), by, F.lit(1), "k")
    # Of the rows - 1 gaps the last in order is the largest; the middle of the others lies at one rank or between two.
    others = F.col("rows") - 2
    near = bounded(per.select(*(F.col(c).alias(f"__{c}") for c in by), "rows"), 64)
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by))
    middle = ranked.join(near, same & F.col("k").between(F.floor((others + 1) / 2), F.floor(others / 2) + 1)).groupBy(*by).agg(F.avg("gap").alias("median_other"))
    return per.join(middle, same_key(per, middle, by), "left").select(*(per[c] for c in by), "rows", "largest", "after_row", F.when(F.col("rows") > 2, F.col("median_other").cast("double")).alias("median_other"))


def gap_candidates(rows: DataFrame, by: list[str], centre: str, ordinal: str, hot: int = HOT_ROWS) -> DataFrame:
    """Groups of LEAST_ROWS or more placed rows whose largest gap is GAP_RATIO times the median of the others.

    Groups of more than ``hot`` rows are scanned in ranges, so none of any size lies in one task.
    """
    few, many = split_hot(rows.where(F.col(centre).isNotNull()), by, hot)
    w = Window.partitionBy(*by).orderBy(centre, ordinal)
    gaps = few.withColumn("gap", F.lead(centre).over(w) - F.col(centre)).withColumn("i", F.row_number().over(w))
    first = Window.partitionBy(*by).orderBy(F.col("gap").desc_nulls_last(), "i")
    ranked = gaps.withColumn("r", F.row_number().over(first))
    per = ranked.groupBy(*by).agg(F.count("*").alias("rows"), F.max("gap").alias("largest"), F.min(F.when(F.col("r") == 1, F.col("i"))).alias("after_row"), F.median(F.when(F.col("r") > 1, F.col("gap"))).alias("median_other"))
    if many is not None:
        per = per.withColumn("median_other", F.col("median_other").cast("double")).unionByName(_gaps_in_ranges(many, by, centre, ordinal))
    return per.where((F.col("rows") >= LEAST_ROWS) & (F.col("median_other") > 0) & (F.col("largest") >= F.col("median_other") * GAP_RATIO)).withColumn("ratio", F.col("largest") / F.col("median_other"))


def mean_left(boxes: Column, fields: list[str] | None = None) -> Column:
    """Mean left coordinate of a map of boxes (of the listed fields, if given); null for none."""
    held = boxes if fields is None else F.map_filter(boxes, lambda k, _: k.isin(fields))
    xs = F.transform(F.map_values(held), lambda b: b[0].cast("double"))
    return F.try_divide(F.aggregate(xs, F.lit(0.0), lambda a, x: a + x), F.size(xs))


def field_mapping(spark, rows: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "left_field string, right_field string, kind string")


def any_true(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
