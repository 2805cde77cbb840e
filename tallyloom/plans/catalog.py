"""All queries of the engine by name, with the SQL that checks them; each family of operators adds its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import auditing, building, evaluation, mining, producing, records, scalars, supplying

Query = Callable[[SparkSession, str], DataFrame]

FAMILIES = (evaluation, mining, scalars, auditing, records, building, producing, supplying)
FLAGSHIP = "agg03_cgs_by_setting"


def queries() -> dict[str, Query]:
    return {k: v for f in FAMILIES for k, v in f.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for f in FAMILIES for k, v in f.SQL.items() if v}
