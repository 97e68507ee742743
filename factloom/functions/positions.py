"""Offsets, lines and columns of text in three encodings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import utf8_width, utf16_width, utf32_width

WIDTHS = {"utf-8": utf8_width, "utf-16": utf16_width, "utf-32": utf32_width}
LINE_END = r"\r\n|\n|\r"


def line_table(files: DataFrame, text_col: str = "text", keys: tuple[str, ...] = ("uri",)) -> DataFrame:
    """One row per line: its number, text, start offset in code points and bytes, and terminator.

    Lines end at CR LF, LF or CR. A text that ends so has an empty last line, and an empty text
    one empty line. Starts are running sums over the lines of one document.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Each terminator is kept beside its line, so that widths in bytes and characters stay known.
    ends = F.regexp_extract_all(text, F.lit(f"({LINE_END})"), 1)
    pieces = F.arrays_zip(F.split(text, LINE_END, -1).alias("line_text"), F.concat(ends, F.array(F.lit(""))).alias("terminator"))
    out = files.select(*keys, F.posexplode(pieces).alias("line", "x")).select(*keys, F.col("line").cast("long").alias("line"), "x.line_text", "x.terminator")
    before = Window.partitionBy(*keys).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    chars = F.char_length("line_text") + F.char_length("terminator")
    size = F.octet_length("line_text") + F.octet_length("terminator")
    zero = F.lit(0).cast("long")
    return out.withColumns({"start_char_offset": F.coalesce(F.sum(chars).over(before), zero), "start_byte": F.coalesce(F.sum(size).over(before), zero)})


def offset_to_position(offsets: DataFrame, lines: DataFrame, encoding: str = "utf-16", keys: tuple[str, ...] = ("uri",)) -> DataFrame:
    """Add line and column to rows (keys, offset): offsets count code points.

    The line is the last one that starts at or before the offset; an offset inside a terminator
    is the end of its line; beyond the text there is no row.
    """
    width = WIDTHS[encoding]
    span = F.char_length("line_text") + F.char_length("terminator")
    last = F.col("terminator") == ""
    hit = (F.col("offset") >= F.col("start_char_offset")) & ((F.col("offset") < F.col("start_char_offset") + span) | (last & (F.col("offset") == F.col("start_char_offset") + span)))
    joined = offsets.join(lines, list(keys)).where(hit)
    prefix = F.substr("line_text", F.lit(1), F.least(F.col("offset") - F.col("start_char_offset"), F.char_length("line_text")).cast("int"))
    return joined.select(*offsets.columns, "line", width(prefix).cast("long").alias("char"))


def prefix_of(line_text: Column, char: Column) -> Column:
    """The beginning of a line with ``char`` UTF-16 units; null if it ends inside a character or past the line."""
    plain = utf16_width(line_text) == F.char_length(line_text)
    direct = F.when(char <= F.char_length(line_text), F.substr(line_text, F.lit(1), char.cast("int")))
    units = F.encode(line_text, "UTF-16BE")
    end = (char * 2).cast("int")
    # The first half of a pair just before the place: the place is inside a character.
    inside = F.hex(F.substr(units, end - 1, F.lit(1))).between("D8", "DB") & (char > 0)
    cut = F.when((end <= F.octet_length(units)) & ~inside, F.decode(F.substr(units, F.lit(1), end), "UTF-16BE"))
    return F.when(char < 0, F.lit(None)).when(plain, direct).otherwise(cut)


def position_to_offset(positions: DataFrame, lines: DataFrame, clamp: bool = False, keys: tuple[str, ...] = ("uri",)) -> DataFrame:
    """Add the code point ``offset`` to rows (keys, line, char), char in UTF-16 units.

    Strict: null where the line doesn't exist, the column is past its end or inside a character.
    Clamping: a column past the end is the end of the line, before its terminator.
    """
    joined = positions.join(lines, [*keys, "line"], "left")
    char = F.least(F.col("char"), utf16_width(F.col("line_text"))) if clamp else F.col("char")
    return joined.select(*positions.columns, (F.col("start_char_offset") + F.char_length(prefix_of(F.col("line_text"), char))).alias("offset"))


def convert_column(line_text: Column, char: Column, to: str) -> Column:
    """A column in UTF-16 units as one in another encoding; null if it isn't a place in the line."""
    return WIDTHS[to](prefix_of(line_text, char)).cast("long")


def diagnostics_in(diagnostics: DataFrame, lines: DataFrame, to: str) -> DataFrame:
    """Diagnostics (uri, range in UTF-16 units) with the range's columns in another encoding: null where one is no place in its line."""
    columns, out = diagnostics.columns, diagnostics
    for side in ("start", "end"):
        own = lines.select("uri", F.col("line").alias(f"{side} line"), F.col("line_text").alias(f"{side} text"))
        out = out.withColumn(f"{side} line", F.col(f"range.{side}_line")).join(own, ["uri", f"{side} line"], "left")
    at = lambda side: convert_column(F.col(f"{side} text"), F.col(f"range.{side}_char"), to).alias(f"{side}_char")
    moved = F.struct("range.start_line", at("start"), "range.end_line", at("end"))
    return out.withColumn("range", moved).select(*columns)


def range_text(text: Column, start: Column, end: Column) -> Column:
    """Code points of ``text`` from offset ``start`` to ``end``; null if these aren't in order or in it."""
    good = (start >= 0) & (start <= end) & (end <= F.char_length(text))
    return F.when(good, F.substr(text, (start + 1).cast("int"), (end - start).cast("int")))


def spliced(text: Column, start: Column, end: Column, new_text: Column) -> Column:
    """``text`` with the code points from ``start`` to ``end`` replaced."""
    return F.concat(F.substr(text, F.lit(1), start.cast("int")), new_text, F.substr(text, (end + 1).cast("int")))


def folded(text: Column, edits: Column) -> Column:
    """Edits (array of start, end, new_text) applied one after another, each to the text the last one left."""
    return F.aggregate(edits, text, lambda t, e: spliced(t, e["start"], e["end"], e["new_text"]))


def identifier_at(line_text: Column, char: Column) -> Column:
    """The identifier that covers or ends at a column of a line (UTF-16 units); null if there is none."""
    before = F.regexp_extract(prefix_of(line_text, char), r"([\p{L}\p{N}_]*)$", 1)
    after = F.regexp_extract(F.substr(line_text, F.char_length(prefix_of(line_text, char)) + 1), r"^([\p{L}\p{N}_]*)", 1)
    return F.nullif(F.concat(before, after), F.lit(""))
