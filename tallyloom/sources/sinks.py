"""Sinks: sorted-key JSON lines, guarded outputs, partitioned subsets, Markdown tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str, valid: Column | None = None) -> None:
    """JSON lines with sorted keys into a fresh folder; with ``valid``, a row it rejects fails the write."""
    if valid is not None:
        df = df.where(F.when(valid, F.lit(True)).otherwise(F.raise_error(F.lit("record rejected by the validator")).cast("boolean")))
    df.select(*sorted(df.columns)).write.mode("errorifexists").json(path, ignoreNullFields=False)


def json_arrays(df: DataFrame, path: str, by: str, order: str) -> None:
    """One JSON array a value of ``by``, in the given order, each a single document in a folder of its own (<by>=<value>)."""
    w = Window.partitionBy(by).orderBy(order)
    first, last = F.row_number().over(w) == 1, F.lead(F.lit(1)).over(w).isNull()
    doc = F.to_json(F.struct(*sorted(c for c in df.columns if c != by)), {"ignoreNullFields": "false"})
    value = F.concat(F.when(first, "[").otherwise(""), doc, F.when(last, "]").otherwise(","))
    df.select(by, value.alias("value")).write.mode("errorifexists").partitionBy(by).text(path)


def subsets(df: DataFrame, path: str, by: str) -> None:
    """Parquet partitioned by subset, into a fresh folder."""
    df.repartition(by).write.mode("errorifexists").partitionBy(by).parquet(path)


def unique_questions(pairs: DataFrame, key: Callable[[str], Column]) -> DataFrame:
    """One row a question key over both sides of all pairs, the first by ordinal, in key order.

    pairs(ordinal, question_a, question_b, document_id, ...); key(side) builds the key from a side's columns.
    """
    sides = pairs.select("ordinal", "document_id", F.explode(F.array(*(F.struct(key(s).alias("question_key"), F.col(f"question_{s}").alias("question")) for s in ("a", "b")))).alias("s")).select("ordinal", "document_id", "s.*")
    one = sides.groupBy("question_key").agg(F.min_by(F.struct("question", "document_id"), "ordinal").alias("r")).select("question_key", "r.*")
    return one.orderBy("question_key")


def markdown(df: DataFrame, title: str, limit: int = 1000) -> str:
    """A small aggregate as a Markdown table; more than ``limit`` rows are refused, not cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report of more than {limit} rows")
    show = lambda v: "n/a" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(show(v) for v in r) + " |" for r in rows)]) + "\n"
