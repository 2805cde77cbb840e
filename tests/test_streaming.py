"""Streams: the visit counter goes on after a restart; windowed counts equal the batch query."""

from tallyloom.streaming import visits


def test_visit_counter_resumes(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()

    def run():
        stream = visits.count_visits(spark.readStream.schema("group_id string").json(str(source)))
        visits.append_batches(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()

    (source / "a.json").write_text('{"group_id":"a"}\n{"group_id":"a"}\n{"group_id":"b"}\n')
    run()
    (source / "b.json").write_text('{"group_id":"a"}\n')
    run()
    got = sorted((r["group_id"], r["visit_no"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", 0), ("a", 1), ("a", 2), ("b", 0)]


def test_state_taken_out_and_put_back_goes_on_as_if_never_stopped(spark, tmp_path):
    rows = [[f"g{(i * i) % 7}" for i in range(40)], [f"g{(i * 3) % 9}" for i in range(50)]]
    for n, part in enumerate(rows):
        spark.createDataFrame([(g,) for g in part], "group_id string").coalesce(1).write.parquet(f"{tmp_path}/in{n}")

    def run(folders, name, initial=None):
        for f in folders:
            visits.append_batches(visits.count_visits(spark.readStream.schema("group_id string").parquet(f"{tmp_path}/{f}"), initial), f"{tmp_path}/out-{name}-{f}", f"{tmp_path}/ck-{name}").awaitTermination()
        return sorted(tuple(r) for f in folders for r in spark.read.parquet(f"{tmp_path}/out-{name}-{f}").select("group_id", "visit_no").collect())

    first = run(["in0"], "a")
    state = visits.visit_counts(spark, f"{tmp_path}/ck-a")
    assert {r["group_id"]: r["visits"] for r in state.collect()} == {g: rows[0].count(g) for g in set(rows[0])}
    state.write.parquet(f"{tmp_path}/state")
    second = run(["in1"], "b", spark.read.parquet(f"{tmp_path}/state"))
    both = rows[0] + rows[1]
    assert sorted(first + second) == sorted((g, i) for g in set(both) for i in range(both.count(g)))
    assert {r["group_id"]: r["visits"] for r in visits.visit_counts(spark, f"{tmp_path}/ck-b").collect()} == {g: both.count(g) for g in set(both)}
