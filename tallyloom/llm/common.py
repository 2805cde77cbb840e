"""Shared helpers of the training-data operators: table access, shared-folder tables, Arrow text chunks, bucket blobs."""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Mapper = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
#: White space of all word and line contracts: blank and the control characters 9 to 13.
SPACES = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"
#: A side is broadcast only when its measured size stays below this many bytes.
BROADCAST_BYTES = 48 << 20
#: Bits of a row's name for its file and for its place there, and seeds that are tried to tell the files apart.
FILE_BITS, PLACE_BITS, SEEDS = 38, 26, 16


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def shared_folder(spark: SparkSession) -> str:
    """This application's part of the folder all executors share (``spark.checkpoint.dir``); it goes when the JVM ends.

    Where the setting is missing, local sessions (tests) get a temporary folder, as driver and executors are one machine;
    on a cluster that would lose rows, so it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tallyloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    own = f"{folder.rstrip('/')}/tallyloom-{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(own)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return own


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a table of the shared folder and read it back, so a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _names_its_rows(docs: DataFrame) -> bool:
    """Whether docs is columns and rows of one file table, each row of a file at most once."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias") and plan.deterministic():
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation"


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs with a long, ``name``, that tells its rows apart and is the same in every pass over them.

    Rows of a Parquet table are named by their file and place in it: FILE_BITS of the file's digest, under a seed for which no two
    files of the table agree (that is looked up, not assumed), and PLACE_BITS of the row's number. The 64 bits are mixed by a
    permutation, so equal names mean equal rows. Any other docs, or one for which no seed does, is written once, with numbers.
    """
    if _names_its_rows(docs):
        with contextlib.suppress(AnalysisException):  # file formats without places
            place = F.col("_metadata.row_index")
            files = materialize(docs.select(F.col("_metadata.file_path").alias("file"), place.alias("place")).groupBy("file").agg(F.max("place").alias("last")), "files")
            digest = lambda file, seed: F.shiftleft(F.xxhash64(file, F.lit(seed)).bitwiseAND(F.lit((1 << FILE_BITS) - 1)), PLACE_BITS)
            for seed in range(SEEDS):
                n, named, last = files.agg(F.count("*"), F.count_distinct(digest("file", seed)), F.max("last")).first()
                if n == named and (last or 0) < 1 << PLACE_BITS:
                    # xxhash64 of one long is a permutation of the longs
                    return docs.select("*", F.xxhash64(digest(F.col("_metadata.file_path"), seed).bitwiseOR(place)).alias(name))
    return materialize(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")


def unused(name: str, columns: list[str]) -> str:
    """The name, or a longer one that none of the columns has (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_join(big: DataFrame, small: DataFrame, on: list[str], how: str, row_bytes: int, rows: int | None = None) -> DataFrame:
    """Join whose small side (keys unique) is broadcast only if rows * row_bytes is within BROADCAST_BYTES; otherwise a shuffle join with the same rows.

    The shuffle join sends the keys apart that hold more rows of ``big`` than a share which no more than BROADCAST_BYTES of
    small's rows can exceed, and rows without a key, so no task gets a hot key.
    """
    n = small.count() if rows is None else rows
    if n * row_bytes <= BROADCAST_BYTES:
        return big.join(F.broadcast(small), on, how)
    count, flag = unused("n", [*big.columns, *small.columns]), unused("hot", [*big.columns, *small.columns])
    held = big.select(*on).dropna().groupBy(*on).agg(F.count("*").alias(count))
    most = max(64, (held.agg(F.sum(count)).first()[0] or 0) * row_bytes // BROADCAST_BYTES + 1)
    hot = materialize(held.where(F.col(count) > most).select(*on, F.lit(True).alias(flag)), "hot-keys")
    marked = big.join(F.broadcast(hot), on, "left")
    apart = F.coalesce(F.col(flag), F.lit(False))
    for k in on:
        apart = apart | F.col(k).isNull()
    first = marked.where(apart).drop(flag).join(F.broadcast(small.join(F.broadcast(hot), on, "left_semi")), on, how)
    return first.unionByName(marked.where(~apart).drop(flag).join(small.hint("merge"), on, how))


def texts(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A text column as one string array, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.string()), "")


def raw_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Zero-copy (bytes, offsets) of a string array."""
    offsets = np.frombuffer(arr.buffers()[1], np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(arr.buffers()[2], np.uint8) if arr.buffers()[2] is not None and arr.buffers()[2].size else np.zeros(0, np.uint8)
    return data, offsets


def chunks(arr: pa.Array, size: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets from 0) for runs of whole texts of about ``size`` bytes."""
    data, offsets = raw_bytes(arr)
    i = 0
    while i < len(arr):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising permutation of 64-bit integers (splitmix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64."""
    have = _POWERS.get(base)
    if have is None or len(have) <= n:
        have = np.full(max(n + 1, 1 << 16), base, np.uint64)
        have[0] = 1
        _POWERS[base] = have = np.multiply.accumulate(have)
    return have


def rolling(data: np.ndarray) -> np.ndarray:
    """Prefix hashes H with H[j] - H[i] = sum of table[byte k] * base ** k for i <= k < j."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * powers(len(data))[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span, whatever its place."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix), _INVERSE)[start] + (end - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of a run of texts, with each text's first word index, and the words' start bytes; words never cross texts."""
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return span_hash(rolling(_LOWER[data] if lower else data), start, end), np.searchsorted(start, offsets), start


def shingles(w: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the width-word runs of each text and each text's first run; a shorter text with words is one run."""
    counts = np.diff(first)
    runs = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    at = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(runs, out=at[1:])
    begin = np.repeat(first[:-1] - at[:-1], runs) + np.arange(at[-1])
    p = powers(width)
    padded = np.concatenate([w, np.zeros(width, np.uint64)])
    total = np.zeros(at[-1], np.uint64)
    length = np.repeat(np.minimum(counts, width), runs)
    for k in range(width):
        total += np.where(k < length, padded[begin + k], np.uint64(0)) * p[k + 1]
    return mix(total + length.astype(np.uint64)), at


def scatter(keys: np.ndarray, columns: list[np.ndarray], buckets: int) -> Iterator[tuple[int, list[bytes]]]:
    """Deal aligned arrays out by key: (bucket, the bytes of each column's part). The bucket comes from the key's upper bits."""
    bucket = (keys >> np.uint64(40)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    bounds = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
    columns = [c[order] for c in columns]
    for b in np.flatnonzero(np.diff(bounds)):
        yield int(b), [c[bounds[b] : bounds[b + 1]].tobytes() for c in columns]


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the input (file sizes for tables); it only sizes the shuffles."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def bucket_count(total_bytes: int, each: int) -> int:
    """Buckets follow the input; beyond 2 ** 20 (some 4 TB of text at 4 MB each) the buckets grow instead of the rows' overhead."""
    return int(max(4, min(1 << 20, total_bytes // each)))


def by_bucket(df: DataFrame, buckets: int) -> DataFrame:
    """Shuffle bucket blobs so that the blobs of a bucket meet, sorted by bucket, in one task; a task gets 16 buckets at most, up to 2 ** 17 tasks."""
    tasks = max(4 * shuffle_partitions(df.sparkSession), min(1 << 17, buckets // 16))
    return df.repartition(min(buckets, tasks), "bucket").sortWithinPartitions("bucket")


def groups(batches: Iterator[pa.RecordBatch], key: str = "bucket") -> Iterator[tuple[object, pa.Table]]:
    """Consecutive rows with the same key, over batch limits, of a partition sorted by it."""
    held: list[pa.RecordBatch] = []
    now: object = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_pylist()
        cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and keys[a] != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)


def blob(table: pa.Table, name: str, dtype: type) -> np.ndarray:
    """The joined content of a binary column."""
    return np.frombuffer(b"".join(x for x in table.column(name).to_pylist() if x), dtype)


def tidy(mapper: Mapper) -> Mapper:
    """The same mapper, giving freed memory back to the system at its end: Python workers idle on between tasks."""

    def run(batches):
        try:
            yield from mapper(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not every C library can
                ctypes.CDLL(None).malloc_trim(0)

    return run


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def arrow_schema(df_schema: str, spark: SparkSession) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(df_schema))

