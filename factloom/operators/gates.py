"""Gates: each is a table of violations, and an answer stands only if all are empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom import schema
from factloom.functions.text import build_context_id
from factloom.operators.facts import coverage_faults, declared_twice, unresolved
from factloom.storage import fixed


def violations(**tables: DataFrame) -> DataFrame:
    """One row per gate: how many violations it has; rows that stand for several say so in ``weight``."""
    out = None
    for name, table in tables.items():
        many = F.coalesce(F.sum("weight"), F.lit(0)) if "weight" in table.columns else F.count("*")
        row = table.agg(many.cast("long").alias("violations")).select(F.lit(name).alias("gate"), "violations")
        out = row if out is None else out.unionByName(row)
    return out


def envelope(answer: DataFrame, gates: DataFrame) -> DataFrame:
    """The answer with status, completeness and reason; a failed gate leaves one row that says unknown.

    The gates are counted once, into a single row; rows of the answer are only given out with it.
    """
    broken = gates.where("violations > 0").agg(F.min("gate").alias("gate")).select("gate")
    ok = answer.join(F.broadcast(broken), F.col("gate").isNull(), "inner").drop("gate")
    good = ok.select(F.lit("exact").alias("status"), F.lit("complete").alias("completeness"), F.lit(None).cast("string").alias("reason"), *answer.columns)
    empty = [F.lit(None).cast(answer.schema[c].dataType).alias(c) for c in answer.columns]
    refused = broken.where("gate IS NOT NULL").select(F.lit("unknown").alias("status"), F.lit("unknown").alias("completeness"), F.col("gate").alias("reason"), *empty)
    return good.unionByName(refused)


def rechecked(answer: DataFrame, changed: DataFrame) -> DataFrame:
    """An enveloped answer after a second look: if anything changed meanwhile, one row that says unknown."""
    moved = changed.limit(1).agg((F.count("*") > 0).alias("moved"))
    rest = [c for c in answer.columns if c not in ("status", "completeness", "reason")]
    good = answer.join(F.broadcast(moved), ~F.col("moved"), "inner").drop("moved")
    empty = [F.lit(None).cast(answer.schema[c].dataType).alias(c) for c in rest]
    refused = moved.where("moved").select(F.lit("unknown").alias("status"), F.lit("unknown").alias("completeness"), F.lit("changed_meanwhile").alias("reason"), *empty)
    return good.unionByName(refused)


def use_counts(occurrences: DataFrame) -> DataFrame:
    """How often each document uses each symbol: gone through once, and read by several gates."""
    return fixed(occurrences.groupBy("scope_id", "symbol_id", "uri", "source_hash").agg(F.count_if(F.col("role") == "reference").alias("references"), F.count("*").alias("n")))


def generation_gates(scopes: DataFrame, symbols: DataFrame, counts: DataFrame, coverage: DataFrame, files: DataFrame, origins: DataFrame | None = None) -> DataFrame:
    """What must hold before a generation is published; ``counts`` are ``use_counts`` or a stored index's.

    ``origins`` are places by scope, uri and source_hash (``weight``), if they are known without the counts.
    """
    references = counts.where("references > 0").groupBy("scope_id", "symbol_id").agg(F.sum("references").alias("weight"))
    if origins is None:
        origins = counts.groupBy("scope_id", "uri", "source_hash").agg(F.sum("n").alias("weight"))
    current = files.select("uri", F.col("sha256").alias("source_hash"))
    return violations(
        repeated_scope=scopes.groupBy("scope_id").agg(F.count("*").alias("n")).where("n > 1"),
        coverage=coverage_faults(scopes, coverage),
        coverage_state=coverage.where(~F.col("state").isin(schema.COVERAGE_STATES)),
        declared_twice=declared_twice(symbols),
        unresolved=unresolved(references, symbols, coverage).where("is_error"),
        unknown_scope=origins.join(scopes, "scope_id", "left_anti"),
        source_hash=origins.join(current, ["uri", "source_hash"], "left_anti"),
    )


def wrong_build_context(scopes: DataFrame, provenance: DataFrame) -> DataFrame:
    """Scopes (scope_id, language, canonical, build_context) whose context isn't the one recomputed, or without equal provenance."""
    again = build_context_id(F.col("language"), F.col("canonical"))
    p = provenance.select("scope_id", F.col("build_context").alias("recorded"), F.lit(True).alias("known"))
    return scopes.join(p, "scope_id", "left").where(~F.coalesce(F.col("known") & (F.col("build_context") == again) & F.col("recorded").eqNullSafe(F.col("build_context")), F.lit(False)))


def fingerprint_changed(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose fingerprints at the start and the end of a query differ, or are on one side only."""
    b, a = before.select(*keys, F.col("fingerprint").alias("b")), after.select(*keys, F.col("fingerprint").alias("a"))
    return b.join(a, keys, "full_outer").where(~F.col("b").eqNullSafe(F.col("a")))


def identity_mismatch(documents: DataFrame, files: DataFrame) -> DataFrame:
    """Documents of an interchange file whose text isn't the one in view."""
    return documents.join(files.select("uri", "sha256"), ["uri", "sha256"], "left_anti")


def triage_faults(reports: DataFrame) -> DataFrame:
    """Reports (classification, regression_test, waiver) that explain nothing."""
    known = F.col("classification").isin("engine_bug", "upstream_bug", "semantic_difference", "build_context")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return reports.where(~F.coalesce(known, F.lit(False)) | (blank("regression_test") & blank("waiver")))


def reproduction_status(bindings: DataFrame, compared: DataFrame) -> DataFrame:
    """Per session: unbound (no identity), backend_changed, diverged or reproduced.

    ``bindings`` has session, recorded and current digests; ``compared`` is of ``zip_compare``.
    """
    rows = bindings.join(compared.select("session", F.col("status").alias("outputs")), "session", "left")
    status = F.when(F.col("recorded").isNull(), "unbound").when(~F.col("recorded").eqNullSafe(F.col("current")), "backend_changed").when(F.coalesce("outputs", F.lit("count_mismatch")) != "equal", "diverged").otherwise("reproduced")
    return rows.select("session", status.alias("status"))


def rename_refusals(exported: Column, collides: Column, complete: Column, fresh: Column) -> Column:
    """Why a rename is refused; null if it may go on."""
    return F.when(exported, "exported symbol").when(collides, "name is taken").when(~complete, "incomplete references").when(~fresh, "stale content")


def witness_gaps(manifest: DataFrame, captured: DataFrame, documents: DataFrame) -> DataFrame:
    """Files of a manifest (path, sha256) that weren't captured as they are, and documents outside it."""
    lost = manifest.join(captured, ["path", "sha256"], "left_anti").select("path", F.lit("not captured").alias("reason"))
    return lost.unionByName(documents.join(manifest, "path", "left_anti").select("path", F.lit("outside the manifest").alias("reason")))
