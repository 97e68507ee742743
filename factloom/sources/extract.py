"""Extractors: table-valued functions from a file to facts, registered by name and chosen by language.

An extractor is a Python function (uri, text) -> rows. It is registered with Spark as a
table function, so that SQL can call it beside a table of files too. One request runs
every extractor on the files of its languages and gives the facts and a report: coverage
of each scope for each kind of fact, and provenance. A file on which an extractor fails
gives its fault and no facts, and leaves the coverage of its scope unknown.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.schema import EDGE_FACT, FACT_KINDS

#: What an extractor's table function returns; a row leaves out what its kind doesn't have.
FACT = "kind string, symbol_id string, name string, symbol_kind string, role string, line bigint, start_char bigint, end_line bigint, end_char bigint, edge string, target string, message string"
COLUMNS = [c.strip().split(" ")[0] for c in FACT.split(",")]


def symbol(symbol_id: str, name: str, symbol_kind: str) -> dict:
    return {"kind": "symbol", "symbol_id": symbol_id, "name": name, "symbol_kind": symbol_kind}


def occurrence(symbol_id: str, role: str, line: int, start_char: int, end_char: int, end_line: int | None = None) -> dict:
    return {"kind": "occurrence", "symbol_id": symbol_id, "role": role, "line": line, "start_char": start_char, "end_line": line if end_line is None else end_line, "end_char": end_char}


def edge(source: str, target: str, kind: str, line: int) -> dict:
    return {"kind": "edge", "symbol_id": source, "target": target, "edge": kind, "line": line}


@dataclass(frozen=True)
class Extractor:
    """``facts`` are the kinds of which the extractor finds all; of other kinds it says nothing."""

    name: str
    version: str
    languages: tuple[str, ...]
    facts: tuple[str, ...]
    extract: Callable[[str, str], Iterable[dict]]

    def function(self) -> str:
        return f"extract_{self.name}"


class ExtractorError(ValueError):
    pass


def handler(extract: Callable[[str, str], Iterable[dict]]):
    class Handler:
        def eval(self, uri, text):
            # The rows of one file are kept until it has ended well.
            try:
                rows = [tuple(map(row.get, COLUMNS)) for row in extract(uri, text)]
            except Exception as e:  # an extractor is foreign code: whatever it raises is this file's fault
                rows = [tuple({"kind": "fault", "message": f"{type(e).__name__}: {e}"}.get(c) for c in COLUMNS)]
            yield from rows

    return Handler


class Extractors:
    """The extractors of a session."""

    def __init__(self, spark: SparkSession):
        self.spark, self.by_language = spark, {}

    def register(self, extractor: Extractor) -> None:
        """Make an extractor known to SQL and choose it for its languages; a language has one."""
        unknown = set(extractor.facts) - set(FACT_KINDS)
        taken = [x for x in extractor.languages if self.by_language.get(x, extractor).name != extractor.name]
        if unknown or taken or not extractor.languages or not extractor.name.isidentifier():
            raise ExtractorError(f"{extractor.name}: kinds not known {sorted(unknown)}, languages taken {taken}")
        self.spark.udtf.register(extractor.function(), F.udtf(handler(extractor.extract), returnType=FACT))
        self.by_language.update(dict.fromkeys(extractor.languages, extractor))

    def export(self, files: DataFrame, folder: str | None = None) -> dict[str, DataFrame]:
        """The facts of files (scope_id, uri, language, text, sha256): symbols, occurrences, edges, faults, coverage, provenance.

        A kind is ``complete`` in a scope if the extractors of all its files find it and none failed
        or gave an edge of a kind that facts don't have; ``unavailable`` if an extractor doesn't find
        it; ``unknown`` if a file failed or its language has no extractor. ``folder``, for as long as the
        facts are read, holds what the extractors gave as Parquet, so that they run once for all facts.
        """
        chosen = sorted({e.name: e for e in self.by_language.values()}.values(), key=lambda e: e.name)
        plain = files.select("scope_id", "uri", "language", F.coalesce("text", F.lit("")).alias("text"), "sha256")
        rows = None
        for e in chosen:
            own = plain.where(F.col("language").isin(*[x for x, y in self.by_language.items() if y.name == e.name]))
            got = self.spark.sql(f"SELECT f.scope_id, f.uri, f.sha256 AS source_hash, r.* FROM {{own}} f, LATERAL {e.function()}(f.uri, f.text) r", own=own)
            rows = got if rows is None else rows.unionByName(got)
        if rows is None:
            raise ExtractorError("no extractor is registered")
        if folder is not None:
            rows.write.parquet(folder)
            rows = self.spark.read.parquet(folder)
        wrong = F.when((F.col("kind") == "edge") & ~F.coalesce(F.col("edge").isin(*EDGE_FACT), F.lit(False)), F.concat(F.lit("no such kind of edge: "), F.coalesce("edge", F.lit(""))))
        wrong = F.coalesce(wrong, F.when((F.col("kind") != "edge") & ~F.coalesce(F.col("kind").isin("symbol", "occurrence", "fault"), F.lit(False)), F.lit("no such kind of row")))
        faults = rows.where(F.col("kind") == "fault").select("scope_id", "uri", "message").unionByName(rows.where(wrong.isNotNull()).select("scope_id", "uri", wrong.alias("message")))
        return {
            "symbols": rows.where("kind = 'symbol'").select("scope_id", F.col("symbol_id").alias("id"), "name", F.col("symbol_kind").alias("kind")).distinct(),
            "occurrences": rows.where("kind = 'occurrence'").select("scope_id", "symbol_id", "uri", "line", "start_char", "end_line", "end_char", "role", "source_hash"),
            "edges": rows.where((F.col("kind") == "edge") & wrong.isNull()).select("scope_id", F.col("symbol_id").alias("from"), F.col("target").alias("to"), F.col("edge").alias("kind"), F.col("uri").alias("source_uri"), "line", "source_hash"),
            "faults": faults,
            "coverage": self.coverage(plain, faults),
            "provenance": self.provenance(plain),
        }

    def _table(self) -> DataFrame:
        rows = [(x, e.name, e.version, list(e.facts)) for x, e in sorted(self.by_language.items())]
        return self.spark.createDataFrame(rows, "language string, extractor string, version string, facts array<string>")

    def coverage(self, files: DataFrame, faults: DataFrame) -> DataFrame:
        of = files.select("scope_id", "language").distinct().join(F.broadcast(self._table()), "language", "left")
        failed = faults.groupBy("scope_id").agg(F.count("*").alias("failed"), F.min("message").alias("message"))
        each = of.select("scope_id", "extractor", "facts", F.explode(F.array(*map(F.lit, FACT_KINDS))).alias("fact"))
        none, lacks = F.col("extractor").isNull(), ~F.array_contains("facts", F.col("fact"))
        by = each.groupBy("scope_id", "fact").agg(F.bool_or(none).alias("none"), F.coalesce(F.bool_or(~none & lacks), F.lit(False)).alias("lacks")).join(failed, "scope_id", "left")
        state = F.when(F.col("none") | F.col("failed").isNotNull(), "unknown").when(F.col("lacks"), "unavailable").otherwise("complete")
        reason = F.when(F.col("none"), "a language has no extractor").when(F.col("failed").isNotNull(), F.col("message")).when(F.col("lacks"), "an extractor doesn't find it")
        return by.select("scope_id", "fact", state.alias("state"), reason.alias("reason"))

    def provenance(self, files: DataFrame) -> DataFrame:
        used = files.select("scope_id", "language").distinct().join(F.broadcast(self._table()), "language")
        return used.groupBy("scope_id", "extractor", "version").agg(F.sort_array(F.collect_set("language")).alias("languages"))
