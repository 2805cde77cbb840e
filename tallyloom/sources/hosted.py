"""A hosted dataset that is read by row number: batch and stream, with numbers that never change.

``publish`` numbers the rows of a table once, in a total order, and writes them in shards of a fixed number of rows; a later
call appends rows that go on counting. The number (``source_index``) is a column of the data, so any reader, in any
order and with any partitioning, sees the same one. ``spark.read.format("hosted_rows")`` then reads the shards as a source of its own:

* partitions are shards, so a dataset of any size is read in parallel and a lost task reads its shard again;
* bounds of source_index that a query filters by choose the shards, and option ``limit`` the first rows, before anything is opened;
* option ``columns`` keeps other columns from being read;
* as a stream its offset is the next number to read: a stopped stream goes on behind the last row it has committed.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from ..operators.ranks import positions

INDEX = "source_index"


def publish(df: DataFrame, order: list[str], path: str, shard_rows: int = 1 << 20) -> int:
    """Append the rows of df, in the given total order, to the dataset at path; returns the number of its rows."""
    spark = df.sparkSession
    known = manifest(path) if _exists(spark, f"{path}/manifest.json") else {"schema": None, "parts": []}
    first = sum(p["rows"] for p in known["parts"])
    part = f"part-{len(known['parts']):05d}"
    # a part that was not named in the manifest is what a failed call left
    numbered = positions(df, order, INDEX).withColumn("shard", F.floor(F.col(INDEX) / shard_rows)).withColumn(INDEX, F.col(INDEX) + first)
    # the sorted ranges are cut where they are: a shard that two of them share has two files
    numbered.write.mode("overwrite").partitionBy("shard").parquet(f"{path}/{part}")
    rows = spark.read.parquet(f"{path}/{part}").count()
    schema = StructType([*df.schema.fields, StructType().add(INDEX, "long").fields[0]]).jsonValue()
    if known["schema"] not in (None, schema):
        raise ValueError("the rows have other columns than the dataset")
    _put(spark, f"{path}/manifest.json", json.dumps({"schema": schema, "parts": [*known["parts"], {"folder": part, "first": first, "rows": rows, "each": shard_rows}]}))
    return first + rows


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small file: written beside it, then renamed."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    new, old = hadoop.Path(f"{path}.new"), hadoop.Path(path)
    fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(new, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(old, False)
    fs.rename(new, old)


def _store(path: str):
    """(file system, path below it) for Python workers, which have no JVM at hand."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)
    return fs.LocalFileSystem(), path


def manifest(path: str) -> dict:
    store, at = _store(path)
    for name in ("manifest.json", "manifest.json.new"):  # the second while the first is being replaced
        try:
            with store.open_input_stream(f"{at}/{name}") as f:
                return json.loads(f.read())
        except FileNotFoundError:
            continue
    raise FileNotFoundError(f"no dataset at {path}")


@dataclass
class Shard(InputPartition):
    """Rows first to last (both included) of one shard's folder."""

    folder: str
    first: int
    last: int


def shards(known: dict, low: int, high: int) -> list[Shard]:
    """The shards with rows from low to high (excluded)."""
    out = []
    for p in known["parts"]:
        begin, end = max(low, p["first"]), min(high, p["first"] + p["rows"])
        for k in range((begin - p["first"]) // p["each"], -(-(end - p["first"]) // p["each"]) if end > begin else 0):
            at = p["first"] + k * p["each"]
            out.append(Shard(f"{p['folder']}/shard={k}", max(begin, at), min(end, at + p["each"]) - 1))
    return out


class _Rows:
    """What both readers share: the columns, and the rows of one shard as Arrow batches."""

    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def read(self, part: Shard | None):
        import pyarrow.dataset as ds
        from pyspark.sql.pandas.types import to_arrow_schema

        if part is None:  # what Spark reads where there are no partitions
            return
        store, at = _store(self.path)
        data = ds.dataset(f"{at}/{part.folder}", filesystem=store, format="parquet", exclude_invalid_files=False)
        inside = (ds.field(INDEX) >= part.first) & (ds.field(INDEX) <= part.last)
        kind = to_arrow_schema(self.schema)
        for batch in data.to_batches(columns=kind.names, filter=inside):
            if batch.num_rows:
                yield batch.cast(kind)


class HostedReader(_Rows, DataSourceReader):
    def __init__(self, path: str, schema: StructType, limit: int | None):
        super().__init__(path, schema)
        self.low, self.high = 0, limit if limit is not None else 1 << 62

    def pushFilters(self, filters):
        """Bounds of the row number choose the shards; other conditions are left to Spark."""
        for f in filters:
            if getattr(f, "attribute", None) == (INDEX,) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value)
                if isinstance(f, GreaterThan):
                    self.low = max(self.low, f.value + 1)
                if isinstance(f, (EqualTo, LessThanOrEqual)):
                    self.high = min(self.high, f.value + 1)
                if isinstance(f, LessThan):
                    self.high = min(self.high, f.value)
            else:
                yield f

    def partitions(self):
        return shards(manifest(self.path), self.low, self.high)


class HostedStream(_Rows, DataSourceStreamReader):
    def initialOffset(self):
        return {"next": 0}

    def latestOffset(self):
        return {"next": sum(p["rows"] for p in manifest(self.path)["parts"])}

    def partitions(self, start, end):
        return shards(manifest(self.path), start["next"], end["next"])


class HostedRows(DataSource):
    """Format ``hosted_rows``; options path, columns (names parted by commas; default: all) and limit (the first rows; batch only)."""

    @classmethod
    def name(cls) -> str:
        return "hosted_rows"

    def schema(self):
        full = StructType.fromJson(manifest(self.options["path"])["schema"])
        names = [c.strip() for c in self.options["columns"].split(",")] if self.options.get("columns") else full.names
        return StructType([full[c] for c in names])

    def reader(self, schema: StructType):
        limit = self.options.get("limit")
        return HostedReader(self.options["path"], schema, None if limit is None else int(limit))

    def streamReader(self, schema: StructType):
        return HostedStream(self.options["path"], schema)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with its filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(HostedRows)


def hosted_rows(spark: SparkSession, path: str, columns: list[str] | None = None, limit: int | None = None) -> DataFrame:
    register(spark)
    options = {"path": path} | ({"columns": ",".join(columns)} if columns else {}) | ({"limit": str(limit)} if limit is not None else {})
    return spark.read.format("hosted_rows").options(**options).load()


def hosted_stream(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    register(spark)
    return spark.readStream.format("hosted_rows").options(path=path, **({"columns": ",".join(columns)} if columns else {})).load()
