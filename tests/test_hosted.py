"""Rows by number from a hosted dataset, and elements of large JSON arrays."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.sources import arrays, hosted, readers
from tallyloom.streaming import visits


@pytest.fixture
def dataset(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}" if i % 5 else None, [i, i + 1]) for i in range(100)], "id long, text string, pair array<long>")
    assert hosted.publish(df.repartition(7), ["id"], f"{tmp_path}/set", shard_rows=16) == 100
    return f"{tmp_path}/set"


def test_rows_keep_their_numbers(spark, dataset):
    got = hosted.hosted_rows(spark, dataset)
    assert got.columns == ["id", "text", "pair", "source_index"]
    assert sorted(map(tuple, got.collect()))[:2] == [(0, None, [0, 1], 0), (1, "t1", [1, 2], 1)]
    assert got.where("id <> source_index").count() == 0 and got.count() == 100


def test_columns_limit_and_bounds_choose_what_is_read(spark, dataset):
    assert sorted(r[0] for r in hosted.hosted_rows(spark, dataset, ["source_index"], limit=20).collect()) == list(range(20))
    some = hosted.hosted_rows(spark, dataset, ["text", "source_index"]).where((F.col("source_index") >= 30) & (F.col("source_index") < 50))
    assert sorted(r["source_index"] for r in some.collect()) == list(range(30, 50))
    assert some.rdd.getNumPartitions() == 3  # of seven shards
    assert hosted.hosted_rows(spark, dataset).where("source_index > 99").count() == 0
    assert hosted.hosted_rows(spark, dataset).where("source_index = 7 and id = 7").count() == 1


def test_a_stopped_stream_goes_on(spark, dataset, tmp_path):
    def run():
        visits.append_batches(hosted.hosted_stream(spark, dataset, ["id", "source_index"]), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
        return sorted((r["source_index"], r["id"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert run() == [(i, i) for i in range(100)]
    more = spark.createDataFrame([(1000 - i, "x", None) for i in range(30)], "id long, text string, pair array<long>")
    assert hosted.publish(more, ["id"], dataset, shard_rows=8) == 130
    assert run() == [(i, i) for i in range(100)] + [(100 + i, 971 + i) for i in range(30)]
    assert run() == run()
    with pytest.raises(ValueError, match="other columns"):
        hosted.publish(more.select("id"), ["id"], dataset)


DOC = "a long, s string, n array<struct<x:long>>"


def made(rng, n):
    texts = ["", "plain", 'quote " comma, ] } [ {', "back\\slash", "\\", '\\"', "é, €, 😀", "line\nend", "," * 9, "[[[", "]]]"]
    return [{"a": i, "s": rng.choice(texts), "n": [{"x": k} for k in range(rng.randint(0, 3))]} for i in range(n)]


@pytest.mark.parametrize("block,indent", [(64, None), (300, 1), (1 << 20, None)])
def test_elements_of_an_array_of_many_blocks(spark, tmp_path, block, indent):
    docs = made(random.Random(block), 80)
    for name, part in (("a", docs), ("b", docs[:1]), ("c", []), ("d", docs[5:8])):
        (tmp_path / f"{name}.json").write_text(" " + json.dumps(part, indent=indent, ensure_ascii=False) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
        got = arrays.json_elements(spark, f"{tmp_path}/*.json", f"struct<{DOC.replace(' long', ':long').replace(' string', ':string').replace('n array', 'n:array')}>").collect()
        one = readers.json_document(spark, f"{tmp_path}/a.json", "struct<a:long,s:string,n:array<struct<x:long>>>").orderBy("ordinal").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = sorted((name, i, d["a"], d["s"], len(d["n"])) for name, part in (("a", docs), ("b", docs[:1]), ("d", docs[5:8])) for i, d in enumerate(part))
    assert sorted((r["file"][-6], r["ordinal"], r["doc"]["a"], r["doc"]["s"], len(r["doc"]["n"])) for r in got) == want
    assert [(r["a"], r["s"]) for r in one] == [(d["a"], d["s"]) for d in docs]
    read = spark.read.schema(DOC).json(f"{tmp_path}/a.json", multiLine=True).collect()
    assert [(r["a"], r["s"], r["n"]) for r in read] == [(r["a"], r["s"], r["n"]) for r in one]


@pytest.mark.parametrize("text", ['{"a": 1, "b": 2}', '[{"a": 1}, {"a": }]', '[{"a": 1}, , {"a": 2}]', "7"])
def test_what_is_no_array_fails(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(Exception, match="no list of documents|FAILFAST|MALFORMED|without value"):
        arrays.json_elements(spark, f"{tmp_path}/x.json", "struct<a:long>").collect()
