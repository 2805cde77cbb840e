"""Elements of JSON arrays too large for one task: bracket depth and quote state, scanned over file blocks.

A JSON array has no line structure to split it by, and whether a comma ends an element depends on all that stands before it. But
a block of the file changes that state in a way that can be told without knowing it: it turns the quote state or not, and moves
the depth by one of two amounts, as it begins inside a string or outside. So one pass takes these three numbers of each block, a
prefix scan over the blocks gives the state at each block's begin, and a second pass cuts every block where it stands.
Only elements that cross a block's end are put together again, two parts a block at most; the rest is never shuffled.

Blocks are those in which Spark reads text, ending at commas: inside a string no escape can be cut by one.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.shared import written


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, value): the text between commas, in order within a block that starts at ``start``."""
    return spark.read.text(path, lineSep=",").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _blocks(batches) -> Iterator[tuple[tuple[str, int], bytes]]:
    """(block, some of its text) of a partition, in order; pieces get their commas back."""
    for batch in batches:
        files, starts, values = (batch.column(i).to_pylist() for i in range(3))
        i = 0
        while i < len(values):
            j = i
            while j < len(values) and (files[j], starts[j]) == (files[i], starts[i]):
                j += 1
            yield (files[i], starts[i]), "".join(f"{v}," for v in values[i:j]).encode()
            i = j


def scan(text: bytes):
    """(bytes, quote state, moves): state after each byte, were it outside a string before; moves of the depth by brackets anywhere."""
    import numpy as np

    b = np.frombuffer(text, np.uint8)
    at = np.arange(len(b))
    # a byte is escaped if an odd number of backslashes stands right before it
    plain = np.maximum.accumulate(np.where(b != 92, at, -1))
    before = np.concatenate([[-1], plain[:-1]])
    escaped = (at - 1 - before) % 2 == 1
    inside = np.cumsum((b == 34) & ~escaped) % 2
    moves = np.isin(b, (91, 123)).astype(np.int64) - np.isin(b, (93, 125))
    return b, inside, moves


def _changes(batches):
    """(file, start, turns, outside, inside) of each block: whether the quote state turns, and the move of the depth from either state."""
    import pyarrow as pa

    now, held = None, [0, 0, 0]
    rows = []
    for block, text in _blocks(batches):
        if block != now:
            rows += [(*now, *held)] if now else []
            now, held = block, [0, 0, 0]
        _, inside, moves = scan(text)
        state = (inside + held[0]) % 2
        held = [int(state[-1]), held[1] + int(moves[state == 0].sum()), held[2] + int(moves[state == 1].sum())]
    rows += [(*now, *held)] if now else []
    names = ["file", "start", "turns", "outside", "inside"]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string() if not i else pa.int64()) for i in range(5)], names=names)


def _begins(changes: DataFrame) -> DataFrame:
    """(file, start, quoted, depth) at the begin of each block: a scan over one row a block."""
    order = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    quoted = changes.withColumn("quoted", F.coalesce(F.sum("turns").over(order), F.lit(0)) % 2)
    moved = F.when(F.col("quoted") == 0, F.col("outside")).otherwise(F.col("inside"))
    return quoted.withColumn("moved", moved).select("file", "start", "quoted", F.coalesce(F.sum("moved").over(order), F.lit(0)).alias("depth"))


def _cut(begins: dict[tuple[str, int], tuple[int, int]]):
    """Mapper to (file, start, n, last, text): the parts of a block between the commas that part elements, the last one without such a comma."""

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        names, types = ["file", "start", "n", "last", "text"], [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]

        def rows(block, n, texts, last):
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(([block[0]] * len(texts), [block[1]] * len(texts), range(n, n + len(texts)), [last] * len(texts), texts), types, strict=True)], names=names)

        now, n, rest = None, 0, b""
        for block, text in _blocks(batches):
            if block != now:
                if now:
                    yield rows(now, n, [rest.decode()], True)
                now, n, rest = block, 0, b""
                quoted, depth = begins[block]
            b, inside, moves = scan(text)
            inside = (inside + quoted) % 2
            level = depth + np.cumsum(np.where(inside == 0, moves, 0))
            ends = np.flatnonzero((b == 44) & (inside == 0) & (level == 1))
            quoted, depth = int(inside[-1]), int(level[-1])
            if len(ends):
                parts = [text[i:j].decode() for i, j in zip([0, *(ends[:-1] + 1)], ends, strict=True)]
                parts[0] = rest.decode() + parts[0]
                yield rows(block, n, parts, False)
                n, rest = n + len(parts), text[ends[-1] + 1 :]
            else:
                rest += text
        if now:
            yield rows(now, n, [rest.decode()], True)

    return cut


def json_elements(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, ordinal, doc): the elements of the JSON array of each file, in order from 0, whatever the size of the files.

    A file that is no array, or an element that does not parse, fails. An element must fit in a task's memory, an array need not.
    """
    pieces = _pieces(spark, path)
    begins = _begins(pieces.mapInArrow(_changes, "file string, start long, turns long, outside long, inside long"))
    # One row a block of a file: some thousands a terabyte.
    state = {(r["file"], r["start"]): (r["quoted"], r["depth"]) for r in begins.collect()}
    parts = written(pieces.mapInArrow(_cut(state), "file string, start long, n long, last boolean, text string"), "elements")

    order = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    ends = parts.where("last").select("file", "start", F.col("n").alias("cuts"))
    shift = ends.withColumn("shift", F.coalesce(F.sum("cuts").over(order), F.lit(0)))
    total = F.sum("cuts").over(Window.partitionBy("file"))
    shift = F.broadcast(shift.withColumn("all", total).select("file", "start", "shift", "all"))
    placed = parts.join(shift, ["file", "start"]).withColumn("ordinal", F.col("n") + F.col("shift"))
    # Only the first and the last part of a block may be shared with other blocks.
    edge = (F.col("n") == 0) | F.col("last")
    whole = placed.where(~edge).select("file", "ordinal", "all", "text")
    joined = placed.where(edge).groupBy("file", "ordinal", "all").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda x: x.text), "").alias("text"))
    text = whole.unionByName(joined.select("file", "ordinal", "all", "text"))
    bare = F.when(F.col("ordinal") == 0, F.regexp_replace("text", r"^\s*\[", "")).otherwise(F.col("text"))
    no_list = (F.col("ordinal") == 0) & ~F.col("text").rlike(r"^\s*\[")
    # the last comma was put there by the reader
    bare = F.when(F.col("ordinal") == F.col("all"), F.regexp_replace(bare, r"\]\s*,?\s*$", "")).otherwise(bare)
    out = text.select("file", "ordinal", "all", F.when(no_list, F.raise_error(F.concat(F.lit("no list of documents in "), "file")).cast("string")).otherwise(bare).alias("text"))
    out = out.where(~((F.col("all") == 0) & (F.trim("text") == "")))  # an empty array
    doc = F.from_json("text", schema, {"mode": "FAILFAST"})
    return out.select("file", "ordinal", F.coalesce(doc, F.raise_error(F.concat(F.lit("an element without value in "), "file")).cast(schema)).alias("doc"))
