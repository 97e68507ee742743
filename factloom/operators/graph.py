"""Closures over edges, level by level or in recursive SQL; they go on until nothing new is reached."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.storage import fixed

#: Levels after which what was seen is fixed again, so that plans don't grow with the depth.
FIXED_LEVELS = 8
#: As many levels as Spark can count; the path of each row ends the recursion before.
NO_LEVEL = 2**31 - 1


def closure(edges: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Nodes that can be reached (root, node, depth) over edges (src, dst), by the shortest way.

    Frontiers are joined level by level and cut to new nodes, so each pair is reached once, and
    the last frontier is empty whatever the depth.
    """
    step = edges.select("src", "dst").distinct()
    start = step.select(F.col("src").alias("root")).distinct() if roots is None else roots.select("root").distinct()
    front = start.join(step, F.col("root") == F.col("src")).select("root", F.col("dst").alias("node")).distinct()
    seen = front.withColumn("depth", F.lit(1))
    parts, depth = int(step.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1
    while not front.isEmpty():
        depth += 1
        front = front.join(step, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct().join(seen.select("root", "node"), ["root", "node"], "left_anti")
        front = fixed(front)
        seen = seen.unionByName(front.withColumn("depth", F.lit(depth)))
        if depth % FIXED_LEVELS == 0:
            seen = fixed(seen.coalesce(parts))
    return seen


def cycles(edges: DataFrame) -> DataFrame:
    """Nodes that can reach themselves."""
    return closure(edges).where("root = node").select("node")


def reference_closure(configs: DataFrame, references: DataFrame) -> DataFrame:
    """The transitive references of each project (config) over (src, dst), with status.

    A cycle or a reference to a config that isn't there refuses the project: its status is
    unknown, whatever else was found.
    """
    reach = closure(references, configs.select(F.col("config").alias("root")))
    known = configs.select(F.col("config").alias("node"), F.lit(True).alias("known"))
    looped = cycles(references).select("node", F.lit(True).alias("looped"))
    rows = configs.select(F.col("config").alias("root")).join(reach, "root", "left").join(known, "node", "left").join(looped, "node", "left")
    own = looped.select(F.col("node").alias("root"), F.col("looped").alias("root_looped"))
    rows = rows.join(own, "root", "left")
    return rows.groupBy("root").agg(
        F.count("node").alias("reached"),
        F.coalesce(F.bool_or(F.col("node").isNotNull() & F.col("known").isNull()), F.lit(False)).alias("dangling"),
        F.coalesce(F.bool_or(F.coalesce("looped", "root_looped", F.lit(False))), F.lit(False)).alias("cyclic"),
    ).withColumn("status", F.when(F.col("dangling") | F.col("cyclic"), "unknown").otherwise("exact"))


def is_descendant(processes: DataFrame, root: int) -> DataFrame:
    """Processes (pid, ppid) with ``descends``: whether the root is above them, or is them."""
    below = closure(processes.select(F.col("ppid").alias("src"), F.col("pid").alias("dst")), processes.sparkSession.createDataFrame([(root,)], "root long"))
    return processes.join(below.select(F.col("node").alias("pid"), F.lit(True).alias("found")), "pid", "left").select("pid", "ppid", (F.coalesce("found", F.lit(False)) | (F.col("pid") == root)).alias("descends"))


def reachable_sql(spark, edges_view: str, start: str) -> DataFrame:
    """As ``closure`` from one node, as a recursive query over a view (src, dst)."""
    return spark.sql(
        f"""WITH RECURSIVE reach(node, depth, path) MAX RECURSION LEVEL {NO_LEVEL} AS (
              SELECT cast(:start AS string), 0, array(cast(:start AS string))
              UNION ALL
              SELECT cast(e.dst AS string), r.depth + 1, array_append(r.path, cast(e.dst AS string))
              FROM reach r JOIN {edges_view} e ON cast(e.src AS string) = r.node
              WHERE NOT array_contains(r.path, cast(e.dst AS string))
            ) SELECT node, min(depth) AS depth FROM reach GROUP BY node""",
        args={"start": start},
    )
