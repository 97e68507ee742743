"""Joins of points and ranges.

Ranges meet points by an equality on the document and, where ranges may be
many, on blocks of lines, so that no join degrades to nested loops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines of a block.
BLOCK = 64


def _key(line: Column, char: Column) -> Column:
    return F.struct(line.alias("line"), char.alias("char"))


def covering(queries: DataFrame, ranges: DataFrame) -> DataFrame:
    """Queries (query_id, uri, line, char) with the ranges (uri, symbol_id, start_line … end_char) around them.

    Ends are exclusive. A query without a range has one row with null range columns.
    """
    blocks = ranges.withColumn("block", F.explode(F.sequence(F.floor(F.col("start_line") / BLOCK), F.floor(F.col("end_line") / BLOCK))))
    place = ["query_id", "uri", "line", "char"]
    q = queries.select(place).distinct().withColumn("block", F.floor(F.col("line") / BLOCK))
    at = _key(F.col("q.line"), F.col("q.char"))
    inside = (_key(F.col("r.start_line"), F.col("r.start_char")) <= at) & (at < _key(F.col("r.end_line"), F.col("r.end_char")))
    same = (F.col("q.uri") == F.col("r.uri")) & (F.col("q.block") == F.col("r.block"))
    # An inner join first: where the queries are few, Spark sends them to the ranges instead of sorting these.
    hits = blocks.alias("r").join(q.alias("q"), same & inside).select(*[F.col(f"q.{c}") for c in place], *[F.col(f"r.{c}") for c in ("symbol_id", "start_line", "start_char", "end_line", "end_char")])
    return queries.select(place).join(hits, place, "left")


def narrowest(queries: DataFrame, ranges: DataFrame) -> DataFrame:
    """The symbol of the narrowest range around each query, with status.

    Narrower means fewer lines, then on one line fewer characters, else the later start. Ranges
    are looked at in the order of their starts; as soon as one is as wide as the best so far and
    has another symbol, the answer is unknown, even if a narrower one follows.
    """
    found = covering(queries, ranges)
    one_line = F.col("start_line") == F.col("end_line")
    width = F.struct(
        (F.col("end_line") - F.col("start_line")).alias("lines"),
        F.when(one_line, F.col("end_char") - F.col("start_char")).otherwise(0).alias("chars"),
        F.when(one_line, 0).otherwise(-F.col("start_line")).alias("later_line"),
        F.when(one_line, 0).otherwise(-F.col("start_char")).alias("later_char"),
    )
    item = F.struct("start_line", "start_char", "end_line", "end_char", "symbol_id", width.alias("width"))
    by = found.groupBy("query_id", "uri", "line", "char").agg(F.sort_array(F.collect_list(F.when(F.col("symbol_id").isNotNull(), item))).alias("items"))
    first = F.struct(F.get("items", F.lit(0)).alias("best"), F.lit(False).alias("tied"))

    def step(state: Column, x: Column) -> Column:
        better = x["width"] < state["best"]["width"]
        tie = (x["width"] == state["best"]["width"]) & (x["symbol_id"] != state["best"]["symbol_id"])
        return F.struct(F.when(better & ~state["tied"], x).otherwise(state["best"]).alias("best"), (state["tied"] | tie).alias("tied"))

    out = by.withColumn("s", F.aggregate(F.slice("items", 2, F.greatest(F.size("items") - 1, F.lit(0))), first, step))
    status = F.when(F.size("items") == 0, "unknown").when(F.col("s.tied"), "unknown").otherwise("exact")
    reason = F.when(F.size("items") == 0, "no symbol at the position").when(F.col("s.tied"), "several symbols at the position")
    return out.select("query_id", "uri", "line", "char", F.when(status == "exact", F.col("s.best.symbol_id")).alias("symbol_id"), status.alias("status"), reason.alias("reason"))


def only_symbol(queries: DataFrame, ranges: DataFrame) -> DataFrame:
    """The symbol at each query; a second one there, however wide its range, makes it unknown."""
    found = covering(queries, ranges).groupBy("query_id", "uri", "line", "char").agg(F.min("symbol_id").alias("a"), F.max("symbol_id").alias("b"))
    status = F.when(F.col("a").isNull() | (F.col("a") != F.col("b")), "unknown").otherwise("exact")
    reason = F.when(F.col("a").isNull(), "no symbol at the position").when(F.col("a") != F.col("b"), "several symbols at the position")
    return found.select("query_id", "uri", "line", "char", F.when(status == "exact", F.col("a")).alias("symbol_id"), status.alias("status"), reason.alias("reason"))


def segments_of(pieces: DataFrame) -> DataFrame:
    """Pieces (key, piece, host_start, host_end, length, generated) as segments of the joined virtual text.

    A generated piece has no width in the host. ``refused`` is set for every segment of a key whose
    pieces overlap, go backwards in the host, or are empty.
    """
    order = Window.partitionBy("key").orderBy("piece")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    out = pieces.withColumn("virt_start", F.coalesce(F.sum("length").over(upto), F.lit(0)).cast("long"))
    out = out.withColumn("virt_end", F.col("virt_start") + F.col("length"))
    bad = (F.col("length") <= 0) | (F.col("host_end") < F.col("host_start")) | (F.col("host_start") < F.coalesce(F.max("host_end").over(upto), F.lit(0))) | (F.col("generated") & (F.col("host_end") != F.col("host_start")))
    out = out.withColumn("bad", bad)
    quality = F.when(F.col("generated"), "unmapped-generated").when(F.col("host_end") - F.col("host_start") == F.col("length"), "exact").otherwise("many-to-one")
    return out.select("key", "piece", "host_start", "host_end", "virt_start", "virt_end", quality.alias("quality"), F.bool_or("bad").over(Window.partitionBy("key")).alias("refused"))


def to_host(points: DataFrame, segments: DataFrame) -> DataFrame:
    """Virtual offsets (key, offset) in the host; the first segment with the offset counts.

    Within a segment that is longer than its host span, offsets past the span are its end.
    Generated text and offsets outside all segments have no place.
    """
    joined = points.join(segments.withColumnRenamed("key", "k"), (F.col("key") == F.col("k")) & (F.col("offset") >= F.col("virt_start")) & (F.col("offset") < F.col("virt_end")), "left")
    first = F.min_by(F.struct("host_start", "host_end", "virt_start", "quality"), "virt_start").alias("s")
    host = F.least(F.col("s.host_start") + F.col("offset") - F.col("s.virt_start"), F.col("s.host_end"))
    out = joined.groupBy("key", "offset").agg(first)
    return out.select("key", "offset", F.when(F.col("s.quality") != "unmapped-generated", host).alias("host_offset"), F.coalesce("s.quality", F.lit("unmapped")).alias("quality"))


def remapped(ranges: DataFrame, spans: DataFrame) -> DataFrame:
    """Generated ranges (uri, start, end) in the sources of the span (uri, gen_start, gen_end, source_uri, source_start) around them."""
    s = spans.withColumnRenamed("uri", "generated_uri")
    inside = (F.col("uri") == F.col("generated_uri")) & (F.col("gen_start") <= F.col("start")) & (F.col("end") <= F.col("gen_end"))
    shift = F.col("source_start") - F.col("gen_start")
    return ranges.join(s, inside, "left").select(*ranges.columns, "source_uri", (F.col("start") + shift).alias("source_range_start"), (F.col("end") + shift).alias("source_range_end"))


def edit_conflicts(edits: DataFrame) -> DataFrame:
    """Pairs of edits (uri, edit_id, start, end) of a file that overlap, and insertions at one place.

    Edits that only touch don't conflict. In the order of starts an edit is held against those
    that begin before it ends, found block by block, so no file is paired with itself.
    """
    size = 256
    blocks = edits.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor(F.col("end") / size))))
    a, b = blocks.alias("a"), blocks.alias("b")
    overlap = (F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end"))
    points = (F.col("a.start") == F.col("a.end")) & (F.col("b.start") == F.col("b.end")) & (F.col("a.start") == F.col("b.start"))
    same = (F.col("a.uri") == F.col("b.uri")) & (F.col("a.block") == F.col("b.block")) & (F.col("a.edit_id") < F.col("b.edit_id"))
    return a.join(b, same & (overlap | points)).select(F.col("a.uri").alias("uri"), F.col("a.edit_id").alias("first_edit"), F.col("b.edit_id").alias("second_edit")).distinct()


def nearest_container(nodes: DataFrame) -> DataFrame:
    """For each node (uri, node_id, start, end) its parent: the smallest wider range that holds it.

    A document's nodes are folded in the order of starts, with those that are still open beside;
    no document is paired with itself.
    """
    item = F.struct("start", (-F.col("end")).alias("neg_end"), "node_id", "end")
    by = nodes.groupBy("uri").agg(F.sort_array(F.collect_list(item)).alias("ns"))
    kind = "struct<start:bigint,end:bigint,node_id:bigint>"
    start = F.struct(F.expr(f"cast(array() as array<{kind}>)").alias("open"), F.expr("cast(array() as array<struct<node_id:bigint,parent_id:bigint>>)").alias("out"))

    def step(a: Column, n: Column) -> Column:
        holding = F.filter(a["open"], lambda o: (o["end"] >= n["end"]) & ((o["end"] - o["start"]) > (n["end"] - n["start"])))
        sized = F.transform(holding, lambda o: F.struct((o["end"] - o["start"]).alias("size"), o["node_id"].alias("node_id")))
        still = F.filter(a["open"], lambda o: o["end"] > n["start"])
        own = F.struct(n["start"].cast("long").alias("start"), n["end"].cast("long").alias("end"), n["node_id"].cast("long").alias("node_id"))
        return F.struct(F.concat(still, F.array(own)).alias("open"), F.concat(a["out"], F.array(F.struct(n["node_id"].cast("long").alias("node_id"), F.array_min(sized)["node_id"].alias("parent_id")))).alias("out"))

    return by.select("uri", F.explode(F.aggregate("ns", start, step)["out"]).alias("o")).select("uri", "o.*")


def sample_slices(legs: DataFrame, samples: DataFrame) -> DataFrame:
    """Samples (round, index, …) with the leg (round, leg, sample_start, sample_count) that holds their index."""
    s, g = samples.alias("s"), legs.alias("g")
    held = (F.col("s.round") == F.col("g.round")) & (F.col("s.index") >= F.col("g.sample_start")) & (F.col("s.index") < F.col("g.sample_start") + F.col("g.sample_count"))
    return g.join(s, held).select("g.round", "g.leg", *[F.col(f"s.{c}") for c in samples.columns if c != "round"])
