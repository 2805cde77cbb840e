"""Sources: JSON lines and documents, OCR sidecars, annotation exports, predictions, manifests, binary look-ups."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.shared import bounded, pieces, written
from .arrays import json_elements

#: Bytes of prediction lines behind one task that groups them.
GROUPED_BYTES = 32 << 20
OCR_ENTRY = "array<struct<c:array<int>,cf:int,t:string>>"


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One row a non-blank line; a bad line fails the read."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, ordinal, line) of non-blank lines in file order; for manifests, whose order and raw keys count.

    Files are read in blocks. A block's lines have successive ids, so a line's ordinal (from 0, blank lines counted) is its
    distance from the block's first line and the lines of the file's blocks before it.
    """
    block = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    lines = spark.read.text(path, lineSep="\n").select(block.alias("b"), F.monotonically_increasing_id().alias("id"), F.regexp_replace("value", r"\r$", "").alias("line"))
    blocks = lines.groupBy("b").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("b.file").orderBy("b.start").rowsBetween(Window.unboundedPreceding, -1)
    blocks = written(blocks.select("b", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift")), "line-blocks")
    # a row a file block: sent to the lines, since a shuffle by block would put whole files into one task
    return lines.where(F.trim("line") != "").join(bounded(blocks, 256), "b").select("b.file", (F.col("id") + F.col("shift")).alias("ordinal"), "line")


def typed_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """raw_lines with the parsed record and, for lines that do not parse, an error flag instead of a failure."""
    parsed = F.from_json("line", schema, {"mode": "PERMISSIVE"})
    return raw_lines(spark, path).select("file", "ordinal", "line", parsed.alias("record")).withColumn("bad", F.try_parse_json("line").isNull())


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Elements of one JSON array with their positions, in as many tasks as the file has blocks."""
    return json_elements(spark, path, schema).select(F.col("ordinal").cast("int").alias("ordinal"), "doc.*")


def index_by(df: DataFrame, key: str, ordinal: str, last: bool = True) -> DataFrame:
    """One row a non-blank key: the last (or first) by ordinal."""
    rest = [c for c in df.columns if c != key]
    pick = (F.max_by if last else F.min_by)(F.struct(*rest), ordinal)
    return df.where(F.coalesce(F.trim(F.col(key).cast("string")), F.lit("")) != "").groupBy(key).agg(pick.alias("r")).select(key, "r.*")


def qa_records(docs: DataFrame, questions: str = "questions") -> DataFrame:
    """Documents by questions, in document and question order."""
    keep = [c for c in docs.columns if c != questions]
    return docs.select(*keep, F.posexplode(questions).alias("question_no", "q")).where(F.col("q").isNotNull()).select(*keep, "question_no", "q.*")


def block_index(docs: DataFrame) -> DataFrame:
    """Blocks of paged documents by uuid; blank ids are left out and a repeated one fails.

    docs(doc_id, pages: array<struct<blocks: array<struct<uuid, order, text, bbox>>>>)
    """
    pages = docs.select("doc_id", F.posexplode("pages").alias("page", "p"))
    blocks = pages.select("doc_id", "page", F.explode("p.blocks").alias("b")).select("doc_id", "page", "b.*").where(F.coalesce(F.trim("uuid"), F.lit("")) != "")
    n = F.count("*").over(Window.partitionBy("doc_id", "uuid"))
    return blocks.withColumn("uuid", F.when(n > 1, F.raise_error(F.concat(F.lit("repeated block "), F.col("uuid"))).cast("string")).otherwise(F.col("uuid")))


def ocr_tokens(spark: SparkSession, root: str) -> DataFrame:
    """Tokens of all <root>/files/*/pages/*/ocr.json in one scan; entries without four coordinates or text are left out."""
    text = spark.read.text(f"{root}/files/*/pages/*/ocr.json", wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    part = lambda i: F.element_at(F.split("path", "/"), i)
    rows = text.select(part(-4).alias("document_id"), part(-2).alias("page"), F.posexplode(F.from_json("value", OCR_ENTRY)).alias("ordinal", "e"))
    fine = (F.size("e.c") == 4) & (F.coalesce(F.col("e.t"), F.lit("")) != "")
    return rows.where(fine).select("document_id", "page", F.col("ordinal").cast("bigint").alias("ordinal"), *(F.col("e.c")[i].alias(n) for i, n in enumerate(("top", "left", "bottom", "right"))), F.col("e.t").alias("text"), F.col("e.cf").alias("confidence"))


def field_instances(export: DataFrame, group: str) -> DataFrame:
    """Instances of one field group with blank values dropped and empty instances left out.

    export(document_id, page_id, group, instance_index, values: map<string,string>, boxes: map<string,struct>)
    """
    cleaned = F.map_filter("values", lambda k, v: F.coalesce(F.trim(v), F.lit("")) != "")
    rows = export.where(F.col("group") == group).withColumn("values", cleaned).where(F.size("values") > 0)
    return rows.withColumn("boxes", F.map_filter("boxes", lambda k, v: v.isNotNull()))


def document_fields(export: DataFrame) -> DataFrame:
    """Values that belong to no group."""
    return field_instances(export.withColumn("group", F.coalesce("group", F.lit(""))), "")


def page_ids(export: DataFrame) -> DataFrame:
    return export.select("document_id", "page_id").distinct()


def predictions(spark: SparkSession, root: str, schema: str, files: str = "*.jsonl") -> DataFrame:
    """Prediction lines of all labels (<root>/<label>/ or <root>/label=<label>/) in one scan; of a label's repeated group the last line counts."""
    label = F.regexp_replace(F.element_at(F.split("file", "/"), -2), "^label=", "")
    lines = typed_lines(spark, f"{root}/*/{files}", schema).select(label.alias("label"), "file", "ordinal", "record.*")
    key, place, rest = ["label", "group_id"], ["file", "ordinal"], [c for c in lines.columns if c not in ("label", "group_id", "file", "ordinal")]
    n = pieces(spark.read.text(f"{root}/*/{files}"), GROUPED_BYTES)
    last = F.max_by(F.struct(*place, *rest), F.struct(*place)).alias("r")
    # first by the task that read them, so that a group of very many lines is not sorted in one task; tasks follow the input
    read = lines.withColumn("task", F.spark_partition_id()).repartition(n, *key, "task").groupBy(*key, "task").agg(last).select(*key, "r.*")
    return read.repartition(n, *key).groupBy(*key).agg(last).select(*key, *(F.col("r")[c].alias(c) for c in rest))


def scored(predicted: DataFrame) -> DataFrame:
    return predicted.where(F.col("document_id").isNotNull())


def manifest(spark: SparkSession, path: str, schema: str, limit: int | None = None) -> DataFrame:
    """The first records of a manifest, in order."""
    rows = raw_lines(spark, path).select("ordinal", F.from_json("line", schema, {"mode": "FAILFAST"}).alias("r")).select("ordinal", "r.*")
    return rows.orderBy("ordinal").limit(limit) if limit is not None else rows


def excluded_keys(manifests: DataFrame) -> DataFrame:
    """Distinct id: and index: keys of excluded tables; for an anti join."""
    keys = F.array(F.when(F.col("source_table_id").isNotNull(), F.concat(F.lit("id:"), "source_table_id")), F.when(F.col("source_index").isNotNull(), F.concat(F.lit("index:"), F.col("source_index").cast("string"))))
    return manifests.select(F.explode(F.array_compact(keys)).alias("key")).distinct()


def first_file(spark: SparkSession, root: str, names: Column, suffix: str) -> DataFrame:
    """(name, path): for each name the first path of <name><suffix> below root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(root).select("path")
    return files.groupBy(F.regexp_replace(F.element_at(F.split("path", "/"), -1), suffix.replace(".", r"\.") + "$", "").alias("name")).agg(F.min("path").alias("path"))


def metrics_report(spark: SparkSession, path: str, keys: list[str]) -> dict[str, float | None]:
    """Named numbers of one JSON report (dotted paths); all null where the file is missing."""
    try:
        text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    except Exception as e:  # a missing path is an answer here, anything else is not
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return dict.fromkeys(keys)
    data = json.loads(text)

    def find(key):
        at = data
        for part in key.split("."):
            at = at.get(part) if isinstance(at, dict) else None
        return at

    return {k: find(k) for k in keys}
