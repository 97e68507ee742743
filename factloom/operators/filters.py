"""Predicates and projections of fact rows."""

from __future__ import annotations

import functools
import json
import operator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom import schema
from factloom.functions.text import valid_hash, valid_range, valid_text


def name_contains(name: Column, query: str) -> Column:
    """Substring test without case; there are no wildcards."""
    return F.contains(F.lower(name), F.lower(F.lit(query)))


def visible(symbols: DataFrame) -> DataFrame:
    """Symbols but those that only own graph nodes, and nameless ones."""
    return symbols.where(~F.col("kind").isin(schema.GRAPH_KINDS) & (F.col("name") != ""))


def with_role(occurrences: DataFrame, request: str, include_declaration: bool = False) -> DataFrame:
    """Rows that a definition, declaration or references request returns."""
    wanted = [request] if request in ("definition", "declaration") else ["reference"]
    if request == "references" and include_declaration:
        wanted += ["definition", "declaration"]
    return occurrences.where(F.col("role").isin(wanted))


def unknown_roles(occurrences: DataFrame) -> DataFrame:
    """Rows with a role outside the domain: one is enough to refuse a query."""
    return occurrences.where(~F.coalesce(F.col("role").isin(schema.ROLES), F.lit(False)))


def record_violations(occurrences: DataFrame) -> DataFrame:
    """One row per broken rule of an occurrence record."""
    rules = {
        "symbol_id is not valid text": ~valid_text(F.col("symbol_id")),
        "uri is not valid text": ~valid_text(F.col("uri")),
        "range is not in order": ~F.coalesce(valid_range(F.col("range")), F.lit(False)),
        "source_hash is not a digest": ~valid_hash(F.col("source_hash")),
        "role is unknown": ~F.coalesce(F.col("role").isin(schema.ROLES), F.lit(False)),
    }
    broken = F.filter(F.array(*[F.when(bad, name) for name, bad in rules.items()]), lambda x: x.isNotNull())
    # Sound records, nearly all, go before any list is made.
    some = functools.reduce(operator.or_, rules.values())
    return occurrences.where(some).select("*", F.explode(broken).alias("violation"))


def in_lines(diagnostics: DataFrame, start: int, end: int) -> DataFrame:
    """Diagnostics that overlap the closed interval of lines."""
    return diagnostics.where((F.col("range.end_line") >= start) & (F.col("range.start_line") <= end))


#: Codes of diagnostics that have a safe fix, with its title and what takes the place of the range.
SAFE_FIXES = {"unused-import": ("Remove unused import", "")}


def code_actions(diagnostics: DataFrame, start: int, end: int) -> DataFrame:
    """The diagnostics (range, code, message) that overlap lines, each with an action: ``title``, ``kind``, ``new_text`` for its range.

    A code without a safe fix gets an explanation only, and its ``new_text`` is null.
    """
    title, new_text = F.concat(F.lit("About this diagnostic: "), F.coalesce("message", F.lit(""))), F.lit(None).cast("string")
    for code, (name, text) in SAFE_FIXES.items():
        title, new_text = (F.when(F.col("code") == code, F.lit(mine)).otherwise(other) for mine, other in ((name, title), (text, new_text)))
    return in_lines(diagnostics, start, end).select("*", title.alias("title"), F.lit("quickfix").alias("kind"), new_text.alias("new_text"), new_text.isNull().alias("explanation_only"))


def by_uri_and_method(evidence: DataFrame, uri: str | None, method: str | None) -> DataFrame:
    for name, value in (("uri", uri), ("method", method)):
        evidence = evidence if value is None else evidence.where(F.col(name) == value)
    return evidence


def each_evidence(results: DataFrame) -> DataFrame:
    return results.select(*[c for c in results.columns if c != "evidence"], F.explode("evidence").alias("evidence"))


def package_matches(package: Column, pattern: str) -> Column:
    """Package patterns: ``...`` stands for any text, and a trailing ``/...`` also for nothing."""
    body = pattern[:-4] if pattern.endswith("/...") else pattern
    quoted = ".*".join("\\Q" + part + "\\E" for part in body.split("..."))
    return package.rlike("^" + quoted + ("(/.*)?$" if pattern.endswith("/...") else "$"))


def without_local_revision(identity: DataFrame) -> DataFrame:
    """A persisted identity: revisions only have a meaning inside one process."""
    return identity.withColumn("snapshot_rev", F.lit(0).cast("long"))


def unregistered_flags(flags: DataFrame, registry: DataFrame, today: Column) -> DataFrame:
    """Flags that the registry (flag, expires) lacks or whose time is over, with the reason."""
    known = registry.select("flag", F.lit(True).alias("known"), "expires")
    joined = flags.join(known, "flag", "left")
    reason = F.when(F.col("known").isNull(), "unregistered").when(F.col("expires") < today, "expired")
    return joined.select(*flags.columns, reason.alias("reason")).where("reason IS NOT NULL")


def declared_tests(lines: DataFrame) -> DataFrame:
    """Test functions that source lines declare: package, name."""
    name = F.regexp_extract("line_text", r"^func (Test[A-Za-z0-9_]*)\(", 1)
    return lines.select("package", name.alias("name")).where("name <> ''").distinct()


def missing_tests(wanted: DataFrame, lines: DataFrame) -> DataFrame:
    return wanted.join(declared_tests(lines), ["package", "name"], "left_anti")


def safe_spans(spans: DataFrame, segments: DataFrame) -> DataFrame:
    """Spans (key, start, end) with ``safe``: exactly one segment holds them, and maps exactly."""
    inside = (spans.key == segments.key) & (segments.host_start <= spans.start) & (spans.end <= segments.host_end)
    held = spans.join(segments, inside, "left").groupBy(spans.key, spans.start, spans.end)
    counts = held.agg(F.count(segments.key).alias("n"), F.count_if(F.col("quality") == "exact").alias("exact"))
    return counts.select("key", "start", "end", ((F.col("n") == 1) & (F.col("exact") == 1)).alias("safe"))


#: Keys that differ from run to run.
VOLATILE_KEYS = ["id", "timestamp", "time", "elapsed", "duration", "pid", "snapshot", "requestId"]


def stable_json(payload: Column, keys: list[str] | None = None) -> Column:
    """JSON text without volatile keys at any depth, keys sorted; other text is left as it is.

    Nesting is unbounded, which SQL can't walk, so batches go through Arrow.
    """
    gone = set(keys or VOLATILE_KEYS)

    def strip(x):
        if isinstance(x, dict):
            return {k: strip(v) for k, v in x.items() if k not in gone}
        return [strip(v) for v in x] if isinstance(x, list) else x

    def one(s):
        try:
            return None if s is None else json.dumps(strip(json.loads(s)), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return s

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(one)

    return run(payload)
