"""Expressions on single values: the hand-computed cases of the semantics."""

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import dates, geometry, numbers, text


def values(spark, expr, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_canonical_numbers(spark):
    cases = {"39.039": "39039", "(8.828.072)": "-8828072", "6,054.049": "6054049", "1.25": "1.25", "0.125": "125", "1.234": "1234", "1,25": "125", "Q1 2020": "12020", "-0": "-0", "(0)": "0", "$ 1,234.50": "1234.5", "007": "7", "none": None, "1.234,56": "1234.56", "12%": "12", "(-5)": "5", "1.2.3": None}
    assert values(spark, numbers.canonical(F.col("t")), [(k,) for k in cases], "t string") == list(cases.values())


def test_strict_and_ocr_values(spark):
    strict = {"(50)": -50.0, "$1,200.5%": 1200.5, "- 5": None, "(-5)": 5.0, "12 apples": None}
    assert values(spark, numbers.strict_value(F.col("t")), [(k,) for k in strict], "t string") == list(strict.values())
    ocr = {"$1.2B": 1.2, "8.5x": 8.5, "€ 6,276,908": 6276908.0, "(3)": -3.0, "word": None}
    assert values(spark, numbers.ocr_value(F.col("t")), [(k,) for k in ocr], "t string") == list(ocr.values())


def test_scale_shift_quirk(spark):
    rows = [("1000", "1"), ("1", "1000"), ("1", "700"), ("3", "1"), ("0", "5")]
    assert values(spark, numbers.scale_shift(F.col("a"), F.col("b")), rows, "a string, b string") == [True, True, True, False, False]


@pytest.mark.parametrize("kind,a,b,status", [("monetary", "$1,200,000", "1200000", "match"), ("monetary", "45000000", "45", "scale_mismatch"), ("text", "London, United Kingdom", "United Kingdom", "granularity_mismatch"), ("date", "October 31, 2011", "Oct-11", "granularity_mismatch"), ("date", "May 5, 2011", "5 May 2011", "match"), ("date", "soon", "2011", "unparseable"), ("numerical", "45000", "45", "mismatch"), ("text", "Answer: 'Yes'", "yes", "match")])
def test_values_match(spark, kind, a, b, status):
    assert values(spark, dates.values_match(F.col("k"), F.col("a"), F.col("b")), [(kind, a, b)], "k string, a string, b string") == [status]


def test_two_digit_years(spark):
    got = spark.createDataFrame([("Oct-11",), ("Jan-69",), ("3/4/68",), ("1st May 2020",)], "t string").select(dates.loose_date(F.col("t")).d.cast("string")).collect()
    assert [r[0] for r in got] == ["2011-10-01", "1969-01-01", "2068-04-03", "2020-05-01"]


def test_labels(spark):
    cases = {"12M Budget": "scenario_basis", "a": "scenario_basis", "actually": "unknown_other", "At Close": "ambiguous_relative", "LTM": "actual_temporal", "FY 2020": "actual_temporal"}
    assert values(spark, text.label_class(F.col("t")), [(k,) for k in cases], "t string") == list(cases.values())


def test_tags(spark):
    good = "<answer> 5 </answer>\n<bbox>1 2 30 40</bbox>"
    bad = ["<bbox>30 2 1 40</bbox>", "<bbox>1 2 3000 40</bbox>", "<bbox>a b c d</bbox>", "no tags"]
    rows = [(t,) for t in [good, *bad]]
    assert values(spark, text.tag_box(F.col("t")), rows, "t string") == [[1, 2, 30, 40], None, None, None, None]
    assert values(spark, text.tag(F.col("t"), "answer"), rows, "t string") == ["5", None, None, None, None]
    assert values(spark, text.box_before_answer(F.col("t")), rows, "t string")[0] is False


def test_boxes(spark):
    rows = [([0, 0, 10, 10], [5, 5, 15, 15]), ([0, 0, 0, 0], [1, 1, 2, 2])]
    assert values(spark, F.round(geometry.iou(F.col("a"), F.col("b")), 6), rows, "a array<int>, b array<int>") == [round(25 / 175, 6), 0.0]


def test_counterfactual_keeps_the_format(spark):
    got = values(spark, numbers.counterfactual(F.col("t"), F.lit("k")), [("$1,234.50",), ("(75)",), ("0",), ("none",)], "t string")
    assert got[0].startswith("$") and got[0][-3] == "." and got[1][0] == "(" and got[2] in "1357" and got[3] is None
