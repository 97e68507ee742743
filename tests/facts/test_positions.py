from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.functions import positions, text, uri


def utf16(s):
    return len(s.encode("utf-16-be")) // 2


def lines_of(s):
    import re

    return re.split(r"\r\n|\n|\r", s), re.findall(r"\r\n|\n|\r", s) + [""]


CASES = ["", "a", "abc\n", "a\rb\rc", "x\r\ny\r\n", "日本語\nテキスト", "a😀b\n😀", "\t\tz", "\r\n\r\r\n\n"]


def test_line_table(spark):
    df = spark.createDataFrame([(f"u{i}", s) for i, s in enumerate(CASES)] + [("null", None)], "uri string, text string")
    got = positions.line_table(df).orderBy("uri", "line").collect()
    for i, s in enumerate(CASES):
        texts, ends = lines_of(s)
        mine = [r for r in got if r.uri == f"u{i}"]
        assert [r.line_text for r in mine] == texts and [r.terminator for r in mine] == ends
        at = 0
        for r in mine:
            assert r.start_char_offset == at and r.start_byte == len(s[:at].encode())
            at += len(r.line_text) + len(r.terminator)


def test_offsets_and_positions_are_inverse(spark):
    files = spark.createDataFrame([(f"u{i}", s) for i, s in enumerate(CASES)], "uri string, text string")
    offsets = spark.createDataFrame([(f"u{i}", k) for i, s in enumerate(CASES) for k in range(len(s) + 1)], "uri string, offset long")
    lines = positions.line_table(files)
    at = positions.offset_to_position(offsets, lines)
    back = positions.position_to_offset(at.withColumnRenamed("offset", "was"), lines).collect()
    assert len(back) == offsets.count()
    inside = {(f"u{i}", k) for i, s in enumerate(CASES) for k in range(1, len(s)) if s[k - 1 : k + 1] == "\r\n"}
    for r in back:
        assert r.offset == r.was or (r.uri, r.was) in inside


def test_strict_and_clamped(spark):
    lines = positions.line_table(spark.createDataFrame([("u", "a😀b\r\ncd")], "uri string, text string"))
    asked = spark.createDataFrame([("u", 0, c) for c in range(7)] + [("u", 5, 0), ("u", 1, 99)], "uri string, line long, char long")
    strict = {(r.line, r.char): r.offset for r in positions.position_to_offset(asked, lines).collect()}
    assert [strict[0, c] for c in range(7)] == [0, 1, None, 2, 3, None, None] and strict[5, 0] is None and strict[1, 99] is None
    clamped = {(r.line, r.char): r.offset for r in positions.position_to_offset(asked, lines, clamp=True).collect()}
    assert clamped[0, 6] == 3 and clamped[1, 99] == 7 and clamped[5, 0] is None


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet="a😀é\n\r", max_size=8), min_size=1, max_size=6))
def test_widths(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    for r in df.select("s", text.utf8_width(F.col("s")).alias("a"), text.utf16_width(F.col("s")).alias("b"), text.utf32_width(F.col("s")).alias("c")).collect():
        assert (r.a, r.b, r.c) == (len(r.s.encode()), utf16(r.s), len(r.s))


def test_splices(spark):
    df = spark.createDataFrame([("hello", [(0, 1, "J"), (5, 5, "!"), (1, 3, "")])], "t string, es array<struct<start:long,end:long,new_text:string>>")
    assert df.select(positions.folded(F.col("t"), F.col("es")).alias("x")).first().x == "Jlo!"
    one = df.select(positions.spliced(F.col("t"), F.lit(1), F.lit(3), F.lit("--")).alias("a"), positions.range_text(F.col("t"), F.lit(1), F.lit(9)).alias("b"), positions.identifier_at(F.lit("x = foo_1(y)"), F.lit(6)).alias("c")).first()
    assert (one.a, one.b, one.c) == ("h--lo", None, "foo_1")


def test_uris(spark):
    cases = {"FILE:///C:/a%7Eb": "file:///c:/a~b", "HTTP://Ex.com/%41": "http://Ex.com/%41", "file://HOST/x%2fy": "file://host/x%2Fy", "no scheme": None, "file:///a%zz": "file:///a%zz"}
    df = spark.createDataFrame([(k,) for k in cases], "u string").select("u", uri.canonical(F.col("u")).alias("c"))
    assert {r.u: r.c for r in df.collect()} == cases
    inside = lambda u, r: spark.range(1).select(uri.contained(F.lit(u), F.lit(r)).alias("x")).first().x
    assert inside("file:///C:/a/b", "file:///c:/a/") and not inside("file:///c:/ab", "file:///c:/a") and not inside("file:///c:/a/../x", "file:///c:/a")
