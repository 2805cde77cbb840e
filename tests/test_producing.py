"""Variant packets, layouts, company records, and configuration, metadata and frozen selections as files."""

import json

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import company, layout, variants
from tallyloom.sources import frozen


def test_packets_read_patched_cells(spark):
    refs = spark.createDataFrame([("g", "answer", 0, 2, 1, "5"), ("g", "row", 0, 2, 0, "Sales"), ("g", "column", 0, 0, 1, "Years"), ("g", "column", 1, 1, 1, "2018")], "group_id string, role string, place int, row_idx int, col_idx int, text string")
    patches = spark.createDataFrame([("g", "target_value", 2, 1, "7"), ("g", "header_address_swap", 1, 1, "2019"), ("g", "irrelevant_value", 5, 5, "0")], "group_id string, variant string, row_idx int, col_idx int, new_text string")
    got = {r["variant"]: (r["answer"], r["metric"], r["period"], r["changed_cell_ids"]) for r in variants.variant_payloads(refs, patches).collect()}
    assert got == {"clean": ("5", "Sales", "2018", []), "target_value": ("7", "Sales", "2018", ["r02c01"]), "header_address_swap": ("5", "Sales", "2019", ["r01c01"]), "irrelevant_value": ("5", "Sales", "2018", ["r05c05"])}
    assert set(variants.group_records(refs, patches).first()["variants"]) == set(got)


def test_edges_of_a_grid_with_a_missing_column(spark):
    cells = spark.createDataFrame([("t", 0, 0, ""), ("t", 0, 2, "abcdefghij"), ("t", 1, 0, None)], "table_id string, row_idx int, col_idx int, text string")
    assert {r["axis"]: r["edges"] for r in layout.layout(cells).collect()} == {"column": [0, 40, 80, 174], "row": [0, 24, 44]}


def test_boxes_without_area_fail(spark):
    schema = "document_id string, page_id string, instance_index long, split string, image_path string, width int, height int, metric string, period string, answer string, question string, bbox array<int>, group_index long"
    fact = lambda box: spark.createDataFrame([("d", "p", 1, "train", "i", 100, 200, "m", "2019", "(5)", "q", box, 3)], schema)
    r = company.company_records(fact([20, 10, 40, 50])).first()
    assert (r["group_id"], r["evidence"]["bbox_normalised"], r["answer"]["normalised_value"]) == ("company_d_p_1_m_000003", [0.1, 0.1, 0.5, 0.2], -5.0)
    with pytest.raises(Exception, match="without area"):
        company.company_records(fact([20, 10, 20, 50])).collect()


def test_documents_without_values_stay(spark):
    schema = "document_id string, page_id string, surface string, `group` string, instance_index long, values map<string,string>, boxes map<string,array<double>>"
    export = spark.createDataFrame([("a", "1", "table", "company_profile", 1, {"n": "x", "m": " "}, {"n": [0.0, 1.0, 2.0, 3.0], "m": [0.0, 0.0, 1.0, 1.0]}), ("b", "1", "fields", "company_profile", 1, {"n": None}, {})], schema)
    got = {r["document_id"]: r for r in company.profile_documents(export).collect()}
    assert got["b"]["instances"] == [] and got["b"]["table_rows"] == []
    assert got["a"]["table_rows"][0]["values"] == {"n": "x"} and set(got["a"]["table_rows"][0]["boxes"]) == {"n"}


def test_frozen_selection(spark, tmp_path):
    records = spark.createDataFrame([(i, f"t{min(i, 3)}", "adjacent" if i % 2 else "skip") for i in range(7)], "pair_id long, table_id string, construction_rule string")
    what = frozen.freeze(records, records.where("pair_id > 0").select("pair_id"), str(tmp_path / "f"), seed=7)
    read = lambda part: json.loads("\n".join(r[0] for r in spark.read.text(str(tmp_path / "f" / what["folder"] / part), wholetext=True).collect()))
    assert sorted(read("manifest")["pair_ids"]) == [1, 2, 3, 4, 5, 6] and read("manifest")["seed"] == 7
    assert read("audit") == {"adjacent": 3, "skip": 3, "fewest": 1, "most": 4, "median": 1, "tables": 3}
    assert frozen.frozen_audit(records.where(F.lit(False))).first().asDict() == {"adjacent": 0, "skip": 0, "fewest": 0, "most": 0, "median": 0, "tables": 0}
    with pytest.raises(Exception, match="(?i)exist"):
        frozen.freeze(records, records.select("pair_id"), str(tmp_path / "f"))


SCHEMA = "pair_id long, table_id string, construction_rule string"


@pytest.mark.parametrize("fails_at", ["rows", "manifest", "audit", "content", "rename"])
def test_a_run_that_ends_between_steps_leaves_nothing_that_counts(spark, tmp_path, monkeypatch, fails_at):
    records = spark.createDataFrame([(i, f"t{i % 3}", "skip") for i in range(9)], SCHEMA)
    path = str(tmp_path / "f")

    def stop(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        real_lines, real_report, real_content, real_files = frozen.json_lines, frozen.report, frozen.content, frozen._files
        if fails_at == "rows":
            m.setattr(frozen, "json_lines", stop)
        elif fails_at in ("manifest", "audit"):
            m.setattr(frozen, "report", lambda spark, data, at: stop() if at.endswith(fails_at) else real_report(spark, data, at))
        elif fails_at == "content":
            m.setattr(frozen, "content", stop)
        else:

            class Files:
                def __init__(self, fs):
                    self.fs = fs

                def __getattr__(self, name):
                    return stop if name == "rename" else getattr(self.fs, name)

            m.setattr(frozen, "_files", lambda spark, path: (lambda h, fs: (h, Files(fs)))(*real_files(spark, path)))
        with pytest.raises(KeyboardInterrupt):
            frozen.freeze(records, records.select("pair_id"), path)
    with pytest.raises(FileNotFoundError):
        frozen.committed(spark, path, "rows", SCHEMA)
    what = frozen.freeze(records, records.select("pair_id"), path)
    assert frozen.committed(spark, path, "rows", SCHEMA).count() == 9
    assert [p.name for p in (tmp_path / "f").iterdir() if p.is_dir()] == [what["folder"]]


def test_what_is_not_what_was_committed_is_refused(spark, tmp_path):
    records = spark.createDataFrame([(i, f"t{i % 3}", "skip") for i in range(9)], SCHEMA)
    path = str(tmp_path / "f")
    what = frozen.freeze(records, records.select("pair_id"), path)
    part = next((tmp_path / "f" / what["folder"] / "rows").glob("part-*"))
    part.write_text(part.read_text().replace("t1", "t2", 1))
    for crc in part.parent.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(ValueError, match="not what was committed"):
        frozen.committed(spark, path, "rows", SCHEMA)
    assert frozen.committed(spark, path, "rows", SCHEMA, check=False).count() == 9


def test_ids_and_cells_that_are_none_fail(spark):
    from tallyloom.operators import records as rec

    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "i string").select(rec.source_index(F.col("i"))).collect()
    assert [r[0] for r in ids("syn_000012_a_b", "syn_7_")] == ["000012", "7"]
    for bad in ("tat_1_a", "syn_1", "", None):
        with pytest.raises(Exception, match="no group id"):
            ids(bad)
    cells = lambda box: spark.createDataFrame([(("c", None, box),)], "c struct<cell_id:string,text:string,bbox:array<double>>").select(rec.packet_cell(F.col("c")).alias("c")).first()["c"]
    assert cells([1.9, 2.0, 3.2, 4.0]).asDict() == {"cell_id": "c", "text": "", "bbox": [1, 2, 3, 4]}
    for bad in ([1.0, 2.0, 3.0], None):
        with pytest.raises(Exception, match="no box of cell c"):
            cells(bad)


def test_training_pairs_of_kinds_that_are_missing_fail(spark):
    from tallyloom.operators import records as rec

    groups = spark.createDataFrame([(1, "q", {k: (k, "p", "1", "c", ["c"], "stays") for k in ("clean", "target_value")})], "group_id long, question string, variants map<string,struct<image_id:string,image_path:string,answer:string,target_id:string,evidence_ids:array<string>,expected_behavior:string>>")
    visit = lambda kind: spark.createDataFrame([(4, "aa", 1, 1, kind)], "epoch int, place string, group_id long, cycle int, kind string")
    r = rec.training_pairs(groups, visit("target_value")).first()
    assert (r["cycle_index"], r["position_in_cycle"], r["clean"]["image_id"], r["counterfactual"]["cf_type"]) == (1, 1, "clean", "target_value")
    for bad in ("irrelevant_value", "clean", None):
        with pytest.raises(Exception, match="no variant .* of 1"):
            rec.training_pairs(groups, visit(bad)).collect()


def test_configuration_and_metadata(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"model": {"x": 1}}')
    (tmp_path / "l.json").write_text("[1]")
    settings = frozen.config(str(tmp_path / "c.json"))
    with pytest.raises(ValueError):
        frozen.config(str(tmp_path / "l.json"))
    assert frozen.config_path("a/b", str(tmp_path)) == str((tmp_path / "a" / "b").resolve())
    frozen.run_metadata(spark, settings, str(tmp_path / "m"), ("model", "data"), selection_metric="numeric_accuracy")
    data = json.loads("\n".join(r[0] for r in spark.read.text(str(tmp_path / "m"), wholetext=True).collect()))
    assert data["model"] == {"x": 1} and data["data"] == {} and data["selection_metric"] == "numeric_accuracy" and "git_commit" in data
