"""Mixing sources to target weights by weighted fair queueing (DataFrame functions only).

Every source queues its documents in a shuffled order (by a seeded digest of doc_id), repeated for as many epochs as its
target needs. A queued document's virtual finish time is the source's cumulative words up to it divided by the source's
target. The queues are merged by range-sorting on that time, and the merged queue is truncated at the total budget.

Defined cases: a null text or one without words has size 0 and takes 0; a null source is a source of its own, last in the
order of sources; rows that repeat a doc_id, or have none, are separate documents; an empty table gives an empty result; extra columns are
ignored. Running totals never gather a source in one task: each source's queue is cut into digest ranges, summed in
parallel, and shifted by the (bounded) table of range totals; the merged queue is cut into time ranges in the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, materialize, numbered, read, WORD

SEED = "mix-1:"
#: Hex digits of the digest that cut a source's queue into ranges (16 ** 3 ranges a source).
RANGE_DIGITS = 3
#: Time ranges of the merged queue per unit of virtual time, and the last range, which is open.
TIME_RANGES, LAST_RANGE = 16384, 65536
MAX_REPEATS = 3
#: Rows of one doc_id from which on they are shuffled one by one.
MANY = 10_000
WEIGHTS = (5, 2, 1)


def source_targets(sized: DataFrame) -> DataFrame:
    """(source, source_size, weight, target) with targets filled up to MAX_REPEATS times a source's size, one row a source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * MAX_REPEATS).cast("double"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    budget = F.sum("source_size").over(everything).cast("double")
    below = F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)).cast("double")
    # The level if this source is the first below its cap; the true level is the greatest of these.
    per = per.withColumn("level", (budget - below) / rest)
    level = F.max("level").over(everything)
    return per.select("source", "source_size", F.least(F.col("cap"), level * F.col("weight")).alias("target"))


def _order_key(e: Column) -> Column:
    when = (e * F.col("source_size") + F.col("cum")).cast("double") / F.col("target")
    return F.struct(when.alias("t"), F.col("source").isNull().alias("n"), F.coalesce("source", F.lit("")).alias("s"), "h", "size", e.alias("e"))


def _time_range(t: Column) -> Column:
    return F.least(F.floor(t * TIME_RANGES), F.lit(LAST_RANGE).cast("long"))


def mix_sources(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs(doc_id, text, source)."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = materialize(numbered(docs.select("doc_id", "source", "text"), "row").select("doc_id", "source", size.alias("size"), "row"), "mix-sizes")
    # Rows without an id, and those of an id that would fill a range, are shuffled by their row keys; BROADCAST_BYTES bounds such ids.
    many = max(MANY, sized.count() * 16 // BROADCAST_BYTES + 1)
    often = sized.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > many).select("doc_id", F.lit(True).alias("often"))
    own = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    name = F.when(F.col("doc_id").isNull() | F.col("often").isNotNull(), F.concat_ws(":", own, F.col("row").cast("string"))).otherwise(own)
    digest = F.md5(F.concat(F.lit(SEED), name))
    queued = sized.join(F.broadcast(often), "doc_id", "left").select("doc_id", "source", "size", F.substring(digest, 1, 16).alias("h"), F.substring(digest, 1, RANGE_DIGITS).alias("r"))
    targets = source_targets(sized)

    # Totals of the digest ranges, shifted into offsets: at most 16 ** RANGE_DIGITS rows a source.
    totals = queued.groupBy("source", "r").agg(F.sum("size").alias("part"))
    before = Window.partitionBy("source").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("source", "r", F.coalesce(F.sum("part").over(before), F.lit(0)).alias("off"))
    offsets = offsets.join(targets.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    within = Window.partitionBy("source", "r").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, 0)
    run = queued.withColumn("run", F.sum("size").over(within))
    o = offsets.select(F.col("source").alias("os"), F.col("r").alias("orr"), "off", "source_size", "target")
    q = run.join(o, F.col("source").eqNullSafe(F.col("os")) & (F.col("r") == F.col("orr")))
    epochs = F.when(F.col("source_size") > 0, F.ceil(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    q = materialize(q.select("doc_id", "source", "size", "h", (F.col("run") + F.col("off")).alias("cum"), "source_size", "target", epochs.alias("epochs")), "mix-queue")

    turns = F.when(F.col("size") > 0, F.sequence(F.lit(0), F.col("epochs") - 1)).otherwise(F.array().cast("array<int>"))
    entries = q.where("size > 0 and epochs > 0").select("size", F.explode(F.transform(turns, _order_key)).alias("k"))
    entries = entries.withColumn("tr", _time_range(F.col("k.t")))
    budget = q.agg(F.sum("size")).first()[0] or 0
    # At most LAST_RANGE + 1 rows reach the driver, whatever the input.
    left, cut_range = budget, LAST_RANGE + 1
    for tr, total in sorted((x["tr"], x["total"]) for x in entries.groupBy("tr").agg(F.sum("size").alias("total")).collect()):
        if total > left:
            cut_range = tr
            break
        left -= total
    merged = Window.partitionBy("tr").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    edge = entries.where(F.col("tr") == cut_range).withColumn("run", F.sum("size").over(merged))
    last = edge.where(F.col("run") <= left).agg(F.max("k").alias("k")).withColumn("j", F.lit(1))
    if cut_range > LAST_RANGE:
        taken = F.size(turns)
        return q.select("doc_id", "size", "source_size", "target", (F.col("size") * taken).cast("long").alias("taken"))
    cut = last.first()["k"]
    if cut is None:
        is_taken = lambda k: _time_range(k["t"]) < cut_range
    else:
        c = F.struct(F.lit(cut["t"]).alias("t"), F.lit(cut["n"]).alias("n"), F.lit(cut["s"]).alias("s"), F.lit(cut["h"]).alias("h"), F.lit(cut["size"]).cast("long").alias("size"), F.lit(cut["e"]).alias("e"))
        is_taken = lambda k: (_time_range(k["t"]) < cut_range) | ((_time_range(k["t"]) == cut_range) & (k <= c))
    taken = F.size(F.filter(F.transform(turns, _order_key), is_taken))
    return q.select("doc_id", "size", "source_size", "target", (F.col("size") * taken).cast("long").alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents"))


SIZED_SQL = r"""
sized AS (SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM {docs})"""

MIX_SQL = r"""
per AS (SELECT source, sum(size)::BIGINT AS source_size,
        CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
        FROM sized GROUP BY source),
filling AS (SELECT source, source_size, weight, (source_size * 3)::DOUBLE AS cap,
        (sum(source_size) OVER ())::DOUBLE AS budget,
        COALESCE(sum((source_size * 3)::DOUBLE) OVER (ORDER BY (source_size * 3)::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
        (sum(weight) OVER (ORDER BY (source_size * 3)::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS rest
        FROM per),
targets AS (SELECT source, source_size, least(cap, max((budget - below) / rest) OVER () * weight) AS target FROM filling),
queue AS (SELECT s.doc_id, s.source, s.size, t.source_size, t.target, substr(md5('mix-1:' || COALESCE(s.doc_id::VARCHAR, 'null')), 1, 16) AS h
        FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
cums AS (SELECT *, (sum(size) OVER (PARTITION BY source ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS cum,
        row_number() OVER () AS row_no FROM queue),
entries AS (SELECT row_no, size, source, h, e, (e * source_size + cum)::DOUBLE / target AS t
        FROM (SELECT *, unnest(range(0, CASE WHEN source_size > 0 AND size > 0 THEN ceil(target / source_size)::INT ELSE 0 END)) AS e FROM cums)),
merged AS (SELECT row_no, size, sum(size) OVER (ORDER BY t, source NULLS LAST, h, size, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM entries),
took AS (SELECT row_no, sum(size)::BIGINT AS taken FROM merged WHERE run <= (SELECT sum(size) FROM sized) GROUP BY row_no)
SELECT doc_id, size, source_size, target, COALESCE(taken, 0)::BIGINT AS taken FROM cums LEFT JOIN took USING (row_no)"""

ORACLE_SQL = "WITH" + SIZED_SQL.format(docs="documents") + "," + MIX_SQL
