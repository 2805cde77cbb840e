"""Configuration of a run, its metadata, and the frozen selection with manifest and audit."""

from __future__ import annotations

import json
import os
import subprocess
import uuid
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.pairs import pair_checks
from ..operators.sampling import digest
from .sinks import json_lines

#: The file that makes a folder valid.
COMMITTED = "COMMITTED.json"


def config(path: str) -> dict[str, Any]:
    """A configuration file as a mapping; YAML needs its parser, JSON nothing. Anything but a mapping fails."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        data = json.loads(text)
    else:
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("reading YAML needs the yaml package") from e
        data = yaml.safe_load(text)
    if not isinstance(data, dict):
        raise ValueError(f"no mapping in {path}")
    return data


def config_path(value: str, base: str | None = None) -> str:
    """An absolute path; relative ones start at ``base``."""
    path = os.path.expanduser(value)
    return os.path.realpath(path if base is None or os.path.isabs(path) else os.path.join(base, path))


def commit(folder: str = ".") -> str | None:
    """The commit of a working tree; null where there is none."""
    try:
        run = subprocess.run(["git", "rev-parse", "HEAD"], cwd=folder, capture_output=True, text=True)
    except OSError:
        return None
    return run.stdout.strip() or None if run.returncode == 0 else None


def report(spark: SparkSession, data: Mapping[str, Any], path: str) -> None:
    """One small JSON document with sorted keys into a fresh folder, wherever Spark can write."""
    text = json.dumps(data, indent=2, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(path)


def run_metadata(spark: SparkSession, settings: Mapping[str, Any], path: str, sections: tuple[str, ...], **facts: Any) -> None:
    """Commit, chosen sections of the configuration (empty where missing) and named facts of a run."""
    report(spark, {"git_commit": commit(), **{k: settings.get(k, {}) for k in sections}, **facts}, path)


def frozen_audit(records: DataFrame) -> DataFrame:
    """One row: pairs by rule, tables, and the least, largest and upper median number of pairs a table.

    records(table_id, construction_rule). The median is found over counts of counts, one row a distinct count.
    """
    rule = lambda name: F.sum((F.col("construction_rule") == name).cast("bigint"))
    tables = records.groupBy("table_id").agg(F.count("*").alias("n"), rule("adjacent").alias("a"), rule("skip").alias("s"))
    counts = tables.groupBy("n").agg(F.count("*").alias("tables"), F.sum("a").alias("a"), F.sum("s").alias("s"))
    upto = counts.withColumn("upto", F.sum("tables").over(Window.orderBy("n"))).withColumn("all", F.sum("tables").over(Window.partitionBy()))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    median = F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("n")))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return upto.agg(total("a").alias("adjacent"), total("s").alias("skip"), zero(F.min("n")).alias("fewest"), zero(F.max("n")).alias("most"), zero(median).alias("median"), total("tables").alias("tables"))


def content(lines: DataFrame) -> str:
    """Digest of the lines of a text table in any order: their number and two sums of parts of their digests."""
    h = F.sha2(F.col("value"), 256)
    part = lambda i: F.coalesce(F.sum(F.conv(F.substring(h, i, 15), 16, 10).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    n, a, b = lines.agg(F.count("*"), part(1), part(16)).first()
    return f"{n}:{int(a):x}:{int(b):x}"


def _files(spark: SparkSession, path: str):
    """(Hadoop path class, file system of path)."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    return hadoop, hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())


def marker(spark: SparkSession, path: str) -> dict[str, Any] | None:
    """What has been committed at path; null where nothing has."""
    hadoop, fs = _files(spark, path)
    if not fs.exists(hadoop(f"{path}/{COMMITTED}")):
        return None
    return json.loads("\n".join(r[0] for r in spark.read.text(f"{path}/{COMMITTED}").collect()))


def commit_once(spark: SparkSession, path: str, write: Callable[[str], list[str]]) -> dict[str, Any]:
    """Run ``write(folder)`` on a folder of its own below path and make all it wrote valid at once, or nothing.

    ``write`` returns the names of the text tables it has written to the folder. They are read back for their digests, and the
    marker, one small file that names the folder and the digests, is put in place last, if there is none. Readers
    go by the marker alone, so a run that ends anywhere before leaves nothing that counts; the next run clears it away. A
    path that has been committed is refused.
    """
    if marker(spark, path) is not None:
        raise FileExistsError(f"{path} exists and has been committed")
    hadoop, fs = _files(spark, path)
    folder = f"attempt-{uuid.uuid4().hex}"
    names = write(f"{path}/{folder}")
    what = {"folder": folder, "parts": {n: content(spark.read.text(f"{path}/{folder}/{n}")) for n in names}}
    new = hadoop(f"{path}/{folder}/{COMMITTED}")
    out = fs.create(new, False)
    out.write(bytearray(json.dumps(what, sort_keys=True).encode()))
    out.close()
    # a rename is one step; where stores let it replace a file, the look before it narrows the gap between two runs
    if fs.exists(hadoop(f"{path}/{COMMITTED}")) or not fs.rename(new, hadoop(f"{path}/{COMMITTED}")):
        raise FileExistsError(f"{path} has been committed by another run")
    for status in fs.listStatus(hadoop(path)):
        name = status.getPath().getName()
        if name.startswith("attempt-") and name != folder:
            fs.delete(status.getPath(), True)
    return what


def committed(spark: SparkSession, path: str, part: str, schema: str, check: bool = True) -> DataFrame:
    """The rows of a committed part; fails where nothing is committed, or (``check``) the part is not what was committed."""
    what = marker(spark, path)
    if what is None:
        raise FileNotFoundError(f"nothing is committed at {path}")
    at = f"{path}/{what['folder']}/{part}"
    if check and content(spark.read.text(at)) != what["parts"][part]:
        raise ValueError(f"{at} is not what was committed")
    return spark.read.schema(schema).json(at, mode="FAILFAST")


def freeze(records: DataFrame, selection: DataFrame, path: str, **protocol: Any) -> dict[str, Any]:
    """Rows, manifest and audit of a selection, committed together at ``path``; returns the marker.

    selection(pair_id) is bounded by the targets of its protocol, so its ids fit one manifest.
    """
    spark = records.sparkSession
    kept = records.join(selection.select("pair_id"), "pair_id", "left_semi")
    ids = sorted(r[0] for r in selection.select("pair_id").collect())

    def write(folder: str) -> list[str]:
        json_lines(kept, f"{folder}/rows")
        report(spark, {**protocol, "pair_ids": ids, "no_model_prediction_used": True}, f"{folder}/manifest")
        report(spark, frozen_audit(kept).first().asDict(), f"{folder}/audit")
        return ["rows", "manifest", "audit"]

    return commit_once(spark, path, write)


def freeze_subsets(pairs: DataFrame, path: str, seed: int, sample: int, **protocol: Any) -> dict[str, Any]:
    """Subsets with their audit samples, construction summary and validation report, committed together at ``path``.

    pairs(subset, pair_id, pair_type, and the columns of pair_checks). Rows are split by subset in one pass; the summary has a
    row for each subset, pair type and number of pairs, the validation one for each subset and rule.
    """
    spark = pairs.sparkSession
    names = [r[0] for r in pairs.select("subset").distinct().orderBy("subset").collect()]

    def write(folder: str) -> list[str]:
        json_lines(pairs, f"{folder}/pairs")
        rank = F.row_number().over(Window.partitionBy("subset").orderBy(digest(seed, F.col("pair_id")), "pair_id"))
        json_lines(pairs.withColumn("k", rank).where(F.col("k") <= sample).drop("k"), f"{folder}/sample")
        json_lines(subset_summary(pairs), f"{folder}/summary")
        json_lines(subset_validation(pairs, names), f"{folder}/validation")
        report(spark, {**protocol, "subsets": names, "sample_seed": seed, "no_model_prediction_used": True}, f"{folder}/protocol")
        return ["pairs", "sample", "summary", "validation", "protocol"]

    return commit_once(spark, path, write)


def subset_summary(pairs: DataFrame) -> DataFrame:
    """subset, pair_type (null: all), total, documents, most (pairs a document)."""
    counts = pairs.groupBy("subset", "pair_type", "document_a").agg(F.count("*").alias("n"))
    typed = counts.groupBy("subset", "pair_type").agg(F.sum("n").alias("total"), F.count("*").alias("documents"), F.max("n").alias("most"))
    whole = counts.groupBy("subset", "document_a").agg(F.sum("n").alias("n")).groupBy("subset").agg(F.sum("n").alias("total"), F.count("*").alias("documents"), F.max("n").alias("most"))
    return typed.unionByName(whole.withColumn("pair_type", F.lit(None).cast("string")))


def subset_validation(pairs: DataFrame, names: list[str]) -> DataFrame:
    """subset, rule, violations: the integrity rules over each subset of its own."""
    out = None
    for name in names:
        one = pair_checks(pairs.where(F.col("subset") == name)).select(F.lit(name).alias("subset"), "rule", "violations")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else pairs.sparkSession.createDataFrame([], "subset string, rule string, violations long")
