"""Numbers and order statistics without a gathering task: gapless over many sampled ranges, equal to plain sorting."""

from pyspark.sql import functions as F

from tallyloom.operators import metrics, pairs, ranks
from tallyloom.sources import readers


def test_positions_have_no_gap_where_ranges_are_sampled(spark):
    n = 200_000  # far more rows than a range sort of four parts samples
    df = spark.range(n, numPartitions=6).select(F.sha2(F.col("id").cast("string"), 256).alias("k"), F.lit("x").alias("rest"))
    got = ranks.positions(df, ["k"], "i").cache()
    assert tuple(got.agg(F.count("*"), F.count_distinct("i"), F.min("i"), F.max("i")).first()) == (n, n, 0, n - 1)
    assert [r[0] for r in got.orderBy("i").limit(50).select("k").collect()] == [r[0] for r in df.orderBy("k").limit(50).select("k").collect()]
    got.unpersist()
    assert pairs.numbered(df, "p", ["k"]).select("pair_id").distinct().count() == n


def test_positions_of_ties_nulls_and_nothing(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",), ("a",)], "k string")
    assert [(r["k"], r["i"]) for r in ranks.positions(df, ["k"], "i").orderBy("i").collect()] == [(None, 0), ("a", 1), ("a", 2), ("b", 3)]
    assert ranks.positions(df.where("k = 'z'"), ["k"], "i").count() == 0


def test_order_statistics_match_sorted_lists(spark):
    sizes = [5, 1, 3, 3, 8, 2, 13]
    df = spark.createDataFrame([(f"t{i}",) for i, n in enumerate(sizes) for _ in range(n)], "table_id string")
    s = sorted(sizes)
    assert tuple(metrics.coverage(df).first()) == (7, 35, 3.0, 13, s[int(0.25 * 6)], s[int(0.75 * 6)])
    assert tuple(metrics.per_document(df, "table_id").first()) == (1, 13, 5.0, s[7 // 2])
    assert tuple(metrics.coverage(df.where("table_id in ('t0', 't1')")).first())[2] == 3.0
    assert tuple(metrics.coverage(df.where("false")).first()) == (0, None, None, None, None, None)


def test_lines_keep_their_order_over_many_blocks(spark, tmp_path):
    texts = {"a.jsonl": [f'{{"v": {i}}}' if i % 7 else "" for i in range(300)], "b.jsonl": [f'{{"w": {i}}}' for i in range(40)]}
    for name, lines in texts.items():
        (tmp_path / name).write_bytes("\r\n".join(lines).encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    try:
        got = sorted((r["file"].rsplit("/", 1)[1], r["ordinal"], r["line"]) for r in readers.raw_lines(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == sorted((name, i, line) for name, lines in texts.items() for i, line in enumerate(lines) if line)
