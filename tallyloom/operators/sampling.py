"""Seeded samples and schedules as pure functions of digests: splits, epochs, cycles, caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stable_seed
from .metrics import COUNTERFACTUALS
from .shared import written

#: Hexadecimal digits by which a quantile is narrowed at a time, and rows that are few enough to be looked at one by one.
PREFIX_DIGITS, FEW = 3, 4096


def digest(seed: int, *keys: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in keys)), 256)


def assign_splits(tables: DataFrame, seed: int, quotas: dict[str, int], ood_split: str, key: str = "table_id", ood: str = "is_ood") -> DataFrame:
    """Tables in digest order cut at the quotas: out-of-distribution ones only to ood_split, others to the other splits.

    Tables beyond all quotas get null. Ranks are found by top-n over keys and digests alone.
    """
    cuts, top = [], 0
    for name, n in quotas.items():
        if name != ood_split:
            cuts.append((name, top, top + n))
            top += n
    narrow = tables.select(key, ood, digest(seed, F.col(key)).alias("h")).distinct()
    chosen = None
    for flag, bounds, limit in ((False, cuts, top), (True, [(ood_split, 0, quotas.get(ood_split, 0))], quotas.get(ood_split, 0))):
        part = narrow.where(F.col(ood) == flag).orderBy("h", key).limit(limit).withColumn("k", F.row_number().over(Window.orderBy("h", key)) - 1)
        name = F.coalesce(*(F.when(F.col("k").between(a, b - 1), F.lit(n)) for n, a, b in bounds)) if bounds else F.lit(None).cast("string")
        part = part.select(key, name.alias("assigned"))
        chosen = part if chosen is None else chosen.unionByName(part)
    return tables.join(chosen, key, "left")


def epoch_sample(variants: DataFrame, seed: int, epoch: int) -> DataFrame:
    """Each group's clean row and one of its counterfactual rows, drawn by digest. variants(group_id, variant, ...)."""
    order = digest(seed, F.lit(epoch), F.col("group_id"), F.col("variant"))
    w = Window.partitionBy("group_id", F.col("variant") == "clean").orderBy(order, "variant")
    return variants.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def permutation(seed: int, group: Column, cycle: Column) -> Column:
    """The three counterfactual kinds in an order drawn for (group, cycle)."""
    keyed = F.array(*(F.struct(digest(seed, group, cycle, F.lit(k)).alias("h"), F.lit(k).alias("kind")) for k in COUNTERFACTUALS))
    return F.transform(F.array_sort(keyed), lambda x: x.kind)


def visit(seed: int, group: Column, n: Column) -> Column:
    """The kind of a group's n-th visit (from 0): visits run through a fresh permutation each cycle."""
    cycle = F.floor(n / 3).cast("int")
    return F.element_at(permutation(seed, group, cycle), (n % 3).cast("int") + 1)


def schedule(groups: DataFrame, seed: int, cycles: int) -> DataFrame:
    """All visits of all groups over whole cycles: epoch, place (a shuffled order within the epoch by digest), group_id, cycle, kind."""
    visits = groups.select("group_id", F.explode(F.sequence(F.lit(0), F.lit(3 * cycles - 1))).alias("epoch"))
    return visits.select("epoch", digest(seed, F.lit("place"), F.col("epoch"), F.col("group_id")).alias("place"), "group_id", F.floor(F.col("epoch") / 3).cast("int").alias("cycle"), visit(seed, F.col("group_id"), F.col("epoch")).alias("kind"))


def matched_pairs(groups: DataFrame, second: DataFrame, seed: int, cycles: int) -> DataFrame:
    """The same schedule with a clean A and B image a visit; a group without B fails. second(group_id, image_b, ordinal): the last wins."""
    b = second.groupBy("group_id").agg(F.max_by("image_b", "ordinal").alias("image_b"))
    j = schedule(groups, seed, cycles).join(groups.select("group_id", "image_a"), "group_id").join(b, "group_id", "left")
    return j.withColumn("image_b", F.coalesce("image_b", F.raise_error(F.concat(F.lit("no second image for "), F.col("group_id").cast("string"))).cast("string")))


def capped(df: DataFrame, seed: int, by: str, n: int, key: str = "pair_id") -> DataFrame:
    """The first n rows of each group in digest order."""
    w = Window.partitionBy(by).orderBy(digest(seed, F.col(key)), key)
    return df.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= n).drop("__k")


def sampled(df: DataFrame, seed: int, n: int, key: str) -> DataFrame:
    """n rows without replacement, by digest (a top-n, not a full sort)."""
    return df.orderBy(digest(seed, F.col(key)), key).limit(n)


def among_first(df: DataFrame, size: int, h: str, key: str) -> Column:
    """Whether a row is one of the ``size`` first by (h, key): a condition on these columns, for ``df`` or any rows of it.

    h is a hexadecimal digest, and (h, key) names one row. The last of the rows is a quantile of the digests, which is found
    from counts of digest prefixes: the prefix in which the count passes ``size``, then PREFIX_DIGITS more digits of it, until
    its rows are few. No task gathers or sorts the rows; df is read once a step, and the steps grow with the logarithm of its rows.
    """
    if size <= 0:
        return F.lit(False)
    prefix, left, few = "", size, False
    while not few:
        digits = len(prefix) + PREFIX_DIGITS
        # At most 16 ** PREFIX_DIGITS rows reach the driver, whatever the table.
        counts = df.where(F.startswith(h, F.lit(prefix))).groupBy(F.substring(h, 1, digits).alias("p")).agg(F.count("*").alias("n")).collect()
        for p, n in sorted((r["p"], r["n"]) for r in counts):
            if n >= left:
                prefix, few = p, n <= FEW or digits >= 64
                break
            left -= n
        else:
            return F.lit(True)  # no more rows than asked for
    last = df.where(F.startswith(h, F.lit(prefix))).select(h, key).orderBy(h, key).limit(left).orderBy(F.desc(h), F.desc(key)).first()
    return F.coalesce((F.col(h) < F.lit(last[0])) | ((F.col(h) == F.lit(last[0])) & (F.col(key) <= F.lit(last[1]))), F.lit(False))


def dev_split(df: DataFrame, seed: int, fraction: float, key: str) -> DataFrame:
    """Adds is_dev for round(n * fraction) rows (half to even) in digest order; ``key`` names one row. A filter: nothing is shuffled."""
    keyed = df.withColumn("__h", digest(seed, F.col(key)))
    narrow = keyed.select(key, "__h")
    return keyed.withColumn("is_dev", among_first(narrow, round(narrow.count() * fraction), "__h", key)).drop("__h")


def greedy_caps(rows: DataFrame, seed: int, caps: dict[str, int], key: str = "pair_id", total: int | None = None) -> DataFrame:
    """Rows taken in digest order while none of their cap columns is full; null is a value like others; ``key`` names one row.

    The choice is that of one pass in order, found in rounds over all rows at once. Among the rows not yet turned down, one that
    ranks within the cap in each of its groups is taken whatever becomes of those before it; a group whose first ``cap`` rows
    are all taken is full and turns down the rest. The first open row is always decided, and in a random order most are
    within a few rounds (their number grows with the logarithm of the rows). Only the first ``cap`` rows of a group ever meet
    (ranks are limited before the shuffle), and of rows alike in all groups no more than the least cap are looked at at all.
    """
    columns = list(caps)
    least = min([*caps.values(), *([] if total is None else [total])])
    first = F.row_number().over(Window.partitionBy(*columns).orderBy("h", key))
    narrow = rows.select(key, *columns, digest(seed, F.col(key)).alias("h")).withColumn("__k", first).where(F.col("__k") <= least).drop("__k")
    # Groups as strings with null apart, so that they can be joined by equality.
    slot = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias(f"__{c}")
    taken = written(narrow.select(key, "h", *map(slot, columns)).where("false"), "caps-taken")
    open_ = written(narrow.select(key, "h", *map(slot, columns)), "caps-open")
    while open_.limit(1).count():
        both = taken.withColumn("__done", F.lit(1)).unionByName(open_.withColumn("__done", F.lit(0)))
        tops = []
        for c in columns:
            rank = F.row_number().over(Window.partitionBy("__slot").orderBy("h", key))
            tops.append(both.select(key, "h", "__done", F.lit(c).alias("__c"), F.col(f"__{c}").alias("__slot")).withColumn("__k", rank).where(F.col("__k") <= caps[c]))
        top = tops[0]
        for t in tops[1:]:
            top = top.unionByName(t)
        top = written(top, "caps-first")
        sure = top.groupBy(key).agg(F.count("*").alias("n"), F.max("__done").alias("__done")).where((F.col("n") == len(columns)) | (F.col("__done") == 1)).select(key, "__done")
        sure = written(sure, "caps-sure")
        full = top.join(sure.select(key), key).groupBy("__c", "__slot").agg(F.count("*").alias("n"))
        full = written(full.where(F.col("n") >= F.element_at(F.create_map(*(F.lit(x) for c in columns for x in (c, caps[c]))), F.col("__c"))).select("__c", "__slot"), "caps-full")
        new = open_.join(sure.where("__done = 0").select(key), key, "left_semi")
        rest = open_.join(sure.select(key), key, "left_anti")
        for c in columns:
            rest = rest.join(full.where(F.col("__c") == c).select(F.col("__slot").alias(f"__{c}")), f"__{c}", "left_anti")
        taken, open_ = written(taken.unionByName(new.select(*taken.columns)), "caps-taken"), written(rest.select(*taken.columns), "caps-open")
    chosen = taken if total is None else taken.where(among_first(taken, total, "h", key))
    return rows.join(chosen.select(key), key, "left_semi")


def jitter(seed: int, group: Column, choices: list[int]) -> Column:
    """A non-zero choice by digest."""
    usable = [c for c in choices if c]
    return F.element_at(F.array(*map(F.lit, usable)), F.pmod(stable_seed(seed, group), F.lit(len(usable))).cast("int") + 1)
