"""Comparing and merging versions of inventories and sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlay_scan(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """Files of the base with those of the overlay in their place; ``from_overlay`` tells which."""
    names = [c for c in base.columns if c != "uri"]
    b, o = base.alias("b"), overlay.withColumn("in_overlay", F.lit(True)).alias("o")
    return b.join(o, F.col("b.uri") == F.col("o.uri"), "full_outer").select(
        F.coalesce("o.uri", "b.uri").alias("uri"), *[F.when(F.col("o.in_overlay"), F.col(f"o.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in names], F.coalesce("o.in_overlay", F.lit(False)).alias("from_overlay")
    )


def repeated_uris(files: DataFrame) -> DataFrame:
    return files.groupBy("uri").agg(F.count("*").alias("n")).where("n > 1")


def overlay_mismatches(overlay: DataFrame, disk: DataFrame) -> DataFrame:
    """Open documents whose uri, language and hash are not those of a file on disk."""
    return overlay.join(disk, ["uri", "language", "sha256"], "left_anti")


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changes from one inventory (path, size, sha256) to the next: path, change."""
    b, a = before.alias("b"), after.alias("a")
    joined = b.join(a, F.col("b.path") == F.col("a.path"), "full_outer")
    differs = ~(F.col("b.sha256").eqNullSafe(F.col("a.sha256")) & F.col("b.size").eqNullSafe(F.col("a.size")))
    change = F.when(F.col("b.path").isNull(), "created").when(F.col("a.path").isNull(), "deleted").when(differs, "modified")
    return joined.select(F.coalesce("b.path", "a.path").alias("path"), change.alias("change")).where("change IS NOT NULL")


def first_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """The change with the smallest path, as one row; none if the inventories are equal."""
    least = F.min_by(F.struct("path", "change"), "path").alias("c")
    return snapshot_diff(before, after).agg(least).where("c IS NOT NULL").select("c.*")


def unchanged(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: whether two scans are equal, with the number of rows on either side only."""
    gone, new = before.exceptAll(after), after.exceptAll(before)
    counts = gone.agg(F.count("*").alias("gone")).crossJoin(new.agg(F.count("*").alias("new")))
    return counts.withColumn("unchanged", (F.col("gone") == 0) & (F.col("new") == 0))


def zip_compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """Sequences (session, seq, payload) held against each other by position.

    One row per session: status (equal, count_mismatch, diverged) and the first position that differs.
    """
    order = Window.partitionBy("session").orderBy("seq")
    l, r = (x.select("session", F.row_number().over(order).alias("i"), "payload").alias(n) for x, n in ((left, "l"), (right, "r")))
    joined = l.join(r, (F.col("l.session") == F.col("r.session")) & (F.col("l.i") == F.col("r.i")), "full_outer")
    rows = joined.select(F.coalesce("l.session", "r.session").alias("session"), F.coalesce("l.i", "r.i").alias("i"), F.col("l.i").isNotNull().alias("a"), F.col("r.i").isNotNull().alias("b"), F.col("l.payload").eqNullSafe(F.col("r.payload")).alias("same"))
    by = rows.groupBy("session").agg(F.count_if("a").alias("n_left"), F.count_if("b").alias("n_right"), F.min(F.when(F.col("a") & F.col("b") & ~F.col("same"), F.col("i"))).alias("first_difference"))
    status = F.when(F.col("n_left") != F.col("n_right"), "count_mismatch").when(F.col("first_difference").isNotNull(), "diverged").otherwise("equal")
    return by.select("session", "n_left", "n_right", status.alias("status"), F.when(status == "diverged", F.col("first_difference").cast("long")).alias("first_difference"))


def merged_files(parts: DataFrame) -> DataFrame:
    """File lists of several scopes as one, with ``conflict`` where a path has several hashes."""
    return parts.groupBy("path").agg(F.min("sha256").alias("sha256"), (F.count_distinct("sha256") > 1).alias("conflict"))


#: Hex digits of the hash that deals items out to the leaves of a digest.
LEAF_DIGITS = 4


def _two_levels(rows: DataFrame, keys: list[str], leaf: Column, order: Column, text: Column, name: str) -> DataFrame:
    """A digest over leaf digests: a key with many items is never in one row."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda x: x["t"])
    leaves = rows.groupBy(*keys, leaf.alias("leaf")).agg(F.sha2(F.array_join(listed, "\n").cast("binary"), 256).alias("h"), F.count("*").alias("n"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("leaf", "h"))), lambda x: x["h"]), "\n")
    return leaves.groupBy(*keys).agg(F.sha2(joined.cast("binary"), 256).alias("digest"), F.sum("n").alias(name))


def set_digest(rows: DataFrame, keys: list[str], item_hash: str, length: int = 24) -> DataFrame:
    """A digest of each key's item hashes that doesn't depend on their order."""
    h = F.col(item_hash)
    return _two_levels(rows, keys, F.substring(h, 1, LEAF_DIGITS), h, h, "items").withColumn("digest", F.substring("digest", 1, length))


def tree_digest(files: DataFrame, keys: list[str]) -> DataFrame:
    """A digest of the (path, size, sha256) records of each key: by leaves of the path's hash, in the order of paths."""
    record = F.concat_ws("|", "path", F.col("size").cast("string"), "sha256")
    return _two_levels(files, keys, F.substring(F.sha2(F.col("path").cast("binary"), 256), 1, LEAF_DIGITS), F.col("path"), record, "files")
