"""Clustered bootstrap of metric differences and the permutation null, from per-cluster sums."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import rate
from .ranks import positions
from .shared import BROADCAST_BYTES, bounded, written

#: Draws that a task makes at a time.
DRAWS = 1 << 19
#: Rounds of a keyed permutation, and steps of a walk back into its range.
ROUNDS, WALK = 6, 64


def _numbered(clusters: DataFrame, key: str) -> DataFrame:
    """Clusters with their place i from 0 by key and their number n."""
    placed = positions(clusters, [key], "i")
    return placed.crossJoin(F.broadcast(placed.agg(F.count("*").alias("n"))))


def _draws(clusters: DataFrame, replicates: int, seed: int, names: list[str]) -> DataFrame:
    """(replicate, names...) with as many draws with replacement as there are clusters, a replicate at a time, as rows.

    clusters(i, n, ...): numbered from 0, n their number. Every draw is a digest of (seed, replicate, slot), so a lost task
    draws the same again; draws are counted per cluster before they meet its sums. For tables of clusters too large to send to every task.
    """
    slots = clusters.select(F.col("i").alias("slot"), "n").select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    pick = F.pmod(F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("replicate").cast("string"), F.col("slot").cast("string")), 256), 1, 15), 16, 10).cast("bigint"), F.col("n"))
    return slots.groupBy("replicate", pick.alias("i")).agg(F.count("*").alias("times")).join(clusters.select("i", *names), "i")


def counts_of_draws(seed: int, replicate: int, n: int):
    """How often each of n clusters is drawn in a replicate: a vector of multinomial counts, the draws of _draws counted."""
    import numpy as np

    start = hashlib.sha256(f"{seed}:{replicate}:".encode())
    picks = np.empty(n, np.int64)
    for slot in range(n):
        h = start.copy()
        h.update(b"%d" % slot)
        picks[slot] = int(h.hexdigest()[:15], 16) % n
    return np.bincount(picks, minlength=n)


def _replicated(df: DataFrame, n: int, replicates: int, seed: int, value: Callable) -> DataFrame:
    """(replicate, x): value(counts) of each replicate's vector of counts over n clusters; null values are left out.

    Replicates are dealt out in blocks of DRAWS draws or one replicate, so the rows are replicates, never replicates times clusters.
    """
    each = max(1, min(DRAWS // max(n, 1), 512))
    units = -(-replicates // each)

    def blocks(batches):
        import pyarrow as pa

        for batch in batches:
            for unit in batch.column(0).to_pylist():
                rows = range(unit * each, min(replicates, (unit + 1) * each))
                x = [value(counts_of_draws(seed, r, n)) for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(x, pa.float64())], names=["replicate", "x"])

    return df.sparkSession.range(0, units, 1, min(units, 4096)).mapInArrow(blocks, "replicate int, x double").where("x is not null")


def _ratio(a: float, b: float) -> float | None:
    return float(a) / float(b) if b else None


def _interval(x: DataFrame, low: float, high: float) -> DataFrame:
    """replicates, ci_low, ci_high of x(x): order statistics of one number a replicate."""
    s = x.agg(F.sort_array(F.collect_list("x")).alias("s")).where(F.size("s") > 0)
    at = lambda p: F.element_at("s", F.least(F.floor(F.lit(p) * F.size("s")).cast("int"), F.size("s") - 1) + 1)
    return s.select(F.size("s").alias("replicates"), at(low).alias("ci_low"), at(high).alias("ci_high"))


def _small(table: DataFrame, row_bytes: int) -> bool:
    return table.count() * row_bytes <= BROADCAST_BYTES


def bootstrap_delta(a: DataFrame, b: DataFrame, num: Column, den: Column, cluster: str, replicates: int = 1000, seed: int = 0) -> DataFrame:
    """metric(b) - metric(a) over all items, with its 95 % interval over resampled clusters common to both arms.

    The interval's ends are order statistics. Draws in which a side has no denominator are left out. While the sums of the
    clusters stay within BROADCAST_BYTES every task has them, and a replicate is the product of its counts with them; beyond
    that the draws are rows that are counted and joined.
    """
    sums = lambda df, s: df.groupBy(cluster).agg(F.sum(num).alias(f"num_{s}"), F.sum(den).alias(f"den_{s}"))
    sa, sb = written(sums(a, "a"), "sums-a"), written(sums(b, "b"), "sums-b")
    point = sa.agg(rate(F.sum("num_a"), F.sum("den_a")).alias("x")).crossJoin(sb.agg(rate(F.sum("num_b"), F.sum("den_b")).alias("y"))).select((F.col("y") - F.col("x")).alias("delta"))
    both = sa.join(sb, cluster)
    names = ["num_a", "den_a", "num_b", "den_b"]
    if _small(both, 64):
        import numpy as np

        table = both.orderBy(cluster).select(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names)).toArrow()
        v = np.stack([table.column(c).to_numpy() for c in names])

        def delta(times):
            na, da, nb, db = v @ times
            x, y = _ratio(na, da), _ratio(nb, db)
            return None if x is None or y is None else y - x

        deltas = _replicated(a, v.shape[1], replicates, seed, delta)
    else:
        weighted = _draws(_numbered(both, cluster), replicates, seed, names)
        total = lambda c: F.sum(F.col(c) * F.col("times"))
        deltas = weighted.groupBy("replicate").agg((rate(total("num_b"), total("den_b")) - rate(total("num_a"), total("den_a"))).alias("x")).where("x is not null")
    return point.crossJoin(_interval(deltas, 0.025, 0.975))


def macro_bootstrap(tables: DataFrame, cluster: str, replicates: int = 1000, seed: int = 0) -> DataFrame:
    """Bootstrap of a mean over tables; a table drawn twice counts once. tables(cluster, table_id, num, den)."""
    per = written(tables.where(F.col(cluster).isNotNull()).groupBy(cluster, "table_id").agg(F.sum("num").alias("num"), F.sum("den").alias("den")), "sums")
    clusters = per.select(cluster).distinct()
    if _small(per, 64):
        import numpy as np

        # Clusters get their numbers from the sorted rows.
        rows = per.select(cluster, "table_id", *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("num", "den"))).orderBy(cluster, "table_id").toArrow()
        c = rows.column(cluster).combine_chunks().dictionary_encode()
        t = rows.column("table_id").combine_chunks().dictionary_encode(null_encoding="encode")
        at, of, n, m = c.indices.to_numpy(), t.indices.to_numpy(), len(c.dictionary), len(t.dictionary)
        num, den = (rows.column(k).to_numpy() for k in ("num", "den"))

        def mean(times):
            drawn = (times > 0)[at]
            tops, bottoms = np.bincount(of, num * drawn, m), np.bincount(of, den * drawn, m)
            there = bottoms != 0
            return float(math.fsum(tops[there] / bottoms[there]) / there.sum()) if there.any() else None

        return _interval(_replicated(tables, n, replicates, seed, mean), 0.025, 0.975)
    drawn = _draws(_numbered(clusters, cluster), replicates, seed, [cluster]).select("replicate", cluster).distinct()
    means = drawn.join(per, cluster).groupBy("replicate", "table_id").agg(rate(F.sum("num"), F.sum("den")).alias("m")).groupBy("replicate").agg(F.avg("m").alias("x"))
    return _interval(means.where("x is not null"), 0.025, 0.975)


def sides(n: int) -> tuple[int, int]:
    """Sides of the least square or rectangle a x b, b of a - 1 to a, that holds 0..n-1."""
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def _mixed(half: Column, key: Column) -> tuple[Column, Column]:
    """A function of half and key in two steps, the second over the first named y; 31-bit products stay within 64 bits."""
    y = F.col("__y").bitwiseXOR(F.shiftright("__y", 15))
    return F.pmod((half + key) * 1103515245 + 12345, F.lit(1 << 31)), F.shiftright(F.pmod(y * 747796405, F.lit(1 << 31)), 3)


def _again(v: Column, n: int, keys: Column) -> Column:
    """v permuted as often as it takes to fall below n, as one expression; for the few numbers that need it."""
    a, b = sides(n)

    def mixed(half: Column, key: Column) -> Column:
        y = F.pmod((half + key) * 1103515245 + 12345, F.lit(1 << 31))
        return F.shiftright(F.pmod(y.bitwiseXOR(F.shiftright(y, 15)) * 747796405, F.lit(1 << 31)), 3)

    def turn(acc: Column, i: Column) -> Column:
        key = F.element_at(keys, i)
        left, right = F.pmod(acc.l + mixed(acc.r, key), F.lit(a)), F.pmod(acc.r + mixed(acc.l, key), F.lit(b))
        return F.when(i % 2 == 1, F.struct(left.alias("l"), acc.r.alias("r"))).otherwise(F.struct(acc.l.alias("l"), right.alias("r")))

    def step(v: Column) -> Column:
        half = F.struct(F.floor(v / b).cast("bigint").alias("l"), F.pmod(v, F.lit(b)).alias("r"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), half, turn, lambda acc: acc.l * b + acc.r)

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(min(WALK, a * b - n + 1))), v, lambda v, i: F.when(v < n, v).otherwise(step(v)))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("a walk of the permutation did not end")).cast("bigint"))


def permuted(df: DataFrame, x: str, n: int, keys: str, name: str) -> DataFrame:
    """Adds the place of number x (0 to n - 1) in a permutation of these numbers that the array of ROUNDS keys draws.

    A Feistel network over pairs (x div b, x mod b) with sides a and b: each round adds to one half a function of the other and of
    a key, so it can be undone, so it permutes 0 .. a * b - 1. A number beyond n - 1 is permuted again until it falls below:
    that permutes 0 .. n - 1, and it is rare, as a * b exceeds n by less than a. Rounds are projections of one stage.
    """
    a, b = sides(n)
    out = df.withColumn("__0", F.floor(F.col(x) / b).cast("bigint")).withColumn("__1", F.pmod(F.col(x).cast("bigint"), F.lit(b)))
    for i in range(ROUNDS):
        first, second = _mixed(F.col(f"__{1 - i % 2}"), F.col(keys)[i])
        changed = f"__{i % 2}"
        out = out.withColumn("__y", first).withColumn(changed, F.pmod(F.col(changed) + second, F.lit(b if i % 2 else a)))
    out = out.withColumn("__v", F.col("__0") * b + F.col("__1"))
    return out.withColumn(name, F.when(F.col("__v") < n, F.col("__v")).otherwise(_again(F.col("__v"), n, F.col(keys)))).drop("__0", "__1", "__y", "__v")


def permutation_null(items: DataFrame, values: DataFrame, replicates: int = 200, seed: int = 0) -> DataFrame:
    """Share of items whose prediction is a value of their table, against shuffled table labels.

    items(item, table_id, predicted), values(table_id, value). Items are numbered once, in order; in a replicate the item of
    number k meets the table of the item of number permuted(k), which is computed, not sorted. The product of items and replicates is
    only joined, and where numbers and values stay within BROADCAST_BYTES it is not even shuffled.
    """
    known = bounded(written(values.select("table_id", F.col("value").alias("predicted"), F.lit(1).alias("hit")), "values"), 64)
    hit = lambda df: df.join(known, ["table_id", "predicted"], "left")
    observed = hit(items).agg(rate(F.count("hit"), F.count("*")).alias("observed"))
    placed = written(positions(items.select("item", "table_id", "predicted"), ["item"], "k"), "items")
    n = placed.count()
    key = lambda i: F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("replicate").cast("string"), F.lit(str(i))), 256), 1, 7), 16, 10).cast("bigint")
    drawn = items.sparkSession.range(replicates).select(F.col("id").cast("int").alias("replicate")).select("replicate", F.array(*map(key, range(ROUNDS))).alias("keys"))
    each = placed.select("k", "predicted").crossJoin(F.broadcast(drawn))
    left = permuted(each, "k", n, "keys", "k").select("replicate", "predicted", "k")
    labels = bounded(placed.select("k", "table_id"), 64, n)
    null = hit(left.join(labels, "k")).groupBy("replicate").agg(rate(F.count("hit"), F.count("*")).alias("r"))
    s = null.crossJoin(F.broadcast(observed)).agg(F.first("observed").alias("observed"), F.avg("r").alias("null_mean"), F.sort_array(F.collect_list("r")).alias("s"), rate(F.count_if(F.col("r") >= F.col("observed")) + 1, F.count("*") + 1).alias("p"))
    at = lambda p: F.element_at("s", F.least(F.floor(F.lit(p) * F.size("s")).cast("int"), F.size("s") - 1) + 1)
    return s.select("observed", "null_mean", at(0.05).alias("null_p05"), at(0.95).alias("null_p95"), "p")
