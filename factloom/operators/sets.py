"""Set operations on rows and lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.uri import canonical


def union_distinct(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def merged_diagnostics(backend: DataFrame, plugins: DataFrame) -> DataFrame:
    """All diagnostics: the backend's first, then those of plugins (with plugin_id) in their order. Nothing is merged."""
    first = backend.withColumn("source_rank", F.lit(0)).withColumn("plugin_id", F.lit(""))
    rest = plugins.withColumn("source_rank", F.lit(1))
    return first.unionByName(rest)


def missing_facts(required: DataFrame, present: DataFrame) -> DataFrame:
    return required.select("scope_id", "fact").exceptAll(present.select("scope_id", "fact").distinct())


def files_outside(files: DataFrame, nested_roots: DataFrame) -> DataFrame:
    """Files (uri) that are in none of the nested projects (root).

    A root that holds a file is one of the beginnings of the file's path, so they meet by equality.
    """
    roots = nested_roots.select(F.rtrim(canonical(F.col("root")), F.lit("/")).alias("beginning")).distinct()
    parts = F.split(canonical(F.col("uri")), "/", -1)
    beginnings = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    able = files.select("uri").where(~canonical(F.col("uri")).rlike(r"/\.\.(/|$)"))
    held = able.select("uri", F.explode(beginnings).alias("beginning")).join(roots, "beginning", "left_semi").select("uri").distinct()
    return files.join(held, "uri", "left_anti")


def memo_dependents(keys: DataFrame, changed: DataFrame) -> DataFrame:
    """Memo keys (key, deps) with a dependency (kind, id) among the changed ones."""
    deps = keys.select("key", F.explode("deps").alias("d")).select("key", "d.kind", "d.id")
    return deps.join(changed.select("kind", "id").distinct(), ["kind", "id"], "left_semi").select("key").distinct()


def tools_by_path(tools: DataFrame, current: DataFrame) -> DataFrame:
    """Recorded tools (path, sha256) against the current ones: stable only if a path has one hash and it is the current one."""
    known = tools.groupBy("path").agg(F.collect_set("sha256").alias("hashes"))
    now = current.select("path", F.col("sha256").alias("now"))
    return known.join(now, "path", "left").withColumn("stable", F.coalesce((F.size("hashes") == 1) & (F.get("hashes", F.lit(0)) == F.col("now")), F.lit(False)))


def valid_memo(entries: DataFrame, changed: DataFrame, revision: int) -> DataFrame:
    """Memo entries (key, revision, deps) that stay: newer than ``revision`` and without a changed dependency."""
    fresh = entries.where(F.col("revision") > revision)
    return fresh.join(memo_dependents(entries, changed), "key", "left_anti")


def current_diagnostics(diagnostics: DataFrame, documents: DataFrame) -> DataFrame:
    """Diagnostics (uri, version, epoch, …) for the latest version and epoch of their document only."""
    latest = documents.groupBy("uri").agg(F.max(F.struct("version", "epoch")).alias("now")).select("uri", "now.version", "now.epoch")
    return diagnostics.join(latest, ["uri", "version", "epoch"], "left_semi")


def overdue(requests: DataFrame, deadline_ms: float) -> DataFrame:
    """Requests that took longer than allowed."""
    return requests.where(F.col("latency_ms") > deadline_ms)


def once_by_digest(files: DataFrame, compute, digest: str = "sha256") -> DataFrame:
    """Facts of files (uri, digest and what ``compute`` reads), computed once for each digest and given to every file that has it.

    ``compute`` takes the files that stand for their digests and returns rows with the digest; a file without one has no facts.
    Those with the smallest uri stand for it, so texts are not moved to find them.
    """
    chosen = files.groupBy(digest).agg(F.min("uri").alias("uri")).select("uri")
    return files.select("uri", digest).join(compute(files.join(chosen, "uri", "left_semi")), digest)
