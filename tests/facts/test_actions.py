"""Code actions, codes and places of diagnostics, and memory by category."""

import pytest
from pyspark.sql import functions as F

from factloom.functions import positions, text
from factloom.operators import filters, telemetry


def test_diagnostic_codes(spark):
    cases = {
        None: "", "": "", "null": "", " null ": "", '"x"': "x", ' "a\\"b" ': 'a"b', '"null"': "null", "7": "7", " -12 ": "-12", "-0": "0", "1.5": "1.5", "007": "007",
        "9223372036854775807": "9223372036854775807", "9223372036854775808": "9223372036854775808", ' {"a": 1} ': '{"a": 1}', "[1, 2]": "[1, 2]", '"open': '"open', '1}, {"v": 2': '1}, {"v": 2', "true": "true",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "raw string").select("raw", text.diagnostic_code(F.col("raw")).alias("code")).collect()
    assert {r.raw: r.code for r in rows} == cases


DIAGNOSTIC = "uri string, range struct<start_line:long,start_char:long,end_line:long,end_char:long>, code string, message string"


def test_code_actions(spark):
    rows = [("a", (0, 0, 2, 3), "unused-import", "m"), ("a", (3, 0, 3, 1), "other", "why"), ("a", (4, 0, 4, 1), None, None), ("a", (6, 0, 9, 1), "unused-import", "m")]
    got = filters.code_actions(spark.createDataFrame(rows, DIAGNOSTIC), 2, 5).orderBy("range.start_line").collect()
    assert [(r.title, r.new_text, r.explanation_only) for r in got] == [("Remove unused import", "", False), ("About this diagnostic: why", None, True), ("About this diagnostic: ", None, True)]


@pytest.mark.parametrize("to,expected", [("utf-8", [(4, 7), (0, None), (None, 0), (None, None)]), ("utf-32", [(1, 3), (0, None), (None, 0), (None, None)])])
def test_diagnostics_in_other_encodings(spark, to, expected):
    """Places behind an astral character, past the end, inside the character, and of no line."""
    lines = positions.line_table(spark.createDataFrame([("a", "😀éx\n")], "uri string, text string"))
    rows = [("a", (0, 2, 0, 4), "1", ""), ("a", (0, 0, 0, 9), "2", ""), ("a", (0, 1, 1, 0), "3", ""), ("a", (7, 0, 7, 0), "4", "")]
    got = positions.diagnostics_in(spark.createDataFrame(rows, DIAGNOSTIC), lines, to).orderBy("code").collect()
    assert [(r.range.start_char, r.range.end_char) for r in got] == expected


def test_memory(spark):
    usage = spark.createDataFrame([("a", 30), ("a", 30), ("b", 5), (None, 99)], "category string, bytes long")
    limits = spark.createDataFrame([("a", 80), ("c", 10), ("b", 0)], "category string, most long")
    got = {r.category: r for r in telemetry.memory(usage, limits).collect()}
    assert (got["a"].share, got["b"].share, got["c"].share, got["b"].used) == (0.75, 0.0, 0.0, 5)
    assert (got[None].used, got[None].most, got[None].band, got[None].in_total) == (65, 90, "evict", True)
    asks = spark.createDataFrame([(15,), (16,), (0,)], "bytes long")
    assert {r.bytes: r.admitted for r in telemetry.admitted(asks, telemetry.memory(usage, limits)).collect()} == {15: True, 16: False, 0: True}
    tight = telemetry.memory(usage, limits, budget=65)
    assert tight.where("in_total").first().band == "critical" and not any(r.admitted for r in telemetry.admitted(asks, tight).collect())


def test_memory_of_nothing(spark):
    none = telemetry.memory(spark.createDataFrame([], "category string, bytes long"), spark.createDataFrame([], "category string, most long"))
    assert [(r.used, r.most, r.share, r.band) for r in none.collect()] == [(0, 0, 0.0, "normal")]
    assert telemetry.admitted(spark.createDataFrame([(5,)], "bytes long"), none).first().admitted
