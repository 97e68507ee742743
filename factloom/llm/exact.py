"""Exact deduplication as a stateful stream (operator 6).

A log of digests is streamed through a keyed RocksDB state that never expires.
For each digest the state retains the stable identifier of the row that stays,
a content locator (the file and row in it where the text was first met) and the
size of the group; texts never enter the state. A row whose digest has others
is a hit: its full bytes, and those that the locator in the state points to,
are fetched by file and row and compared. Digests that cover several texts are
split by text. With a folder for the state, a later call adds its rows to it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import new_folder, stored

#: Micro-batches of the stream.
BATCHES = 3
#: Parts in which equal texts from many tasks are put together, before they are all in one.
FAN_IN = 16
#: Settings of the state store: on disk, one bounded cache for all stores of an executor, closed between batches.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}
PLACE = ["file", "number"]


def normalised(text: str = "text") -> Column:
    """White space runs as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def in_place(docs: DataFrame) -> bool:
    """Whether each row of ``docs`` is one row of a Parquet file, so that file and row locate it."""
    plan = docs._jdf.queryExecution().analyzed() if hasattr(docs, "_jdf") and "_metadata" not in docs.columns else None
    while plan is not None and plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if plan is None or plan.nodeName() != "LogicalRelation":
        return False
    try:
        return bool(docs.select("_metadata.file_path", "_metadata.row_index").columns)
    except AnalysisException:  # another format
        return False


def located(docs: DataFrame) -> DataFrame:
    """``docs`` where its rows have locators: itself, or a copy in the shared folder."""
    return docs if in_place(docs) else stored(docs, "content")


def contents(docs: DataFrame, text_col: str) -> DataFrame:
    """The normalised text of each row, and its locator (file, number)."""
    return docs.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("number"), normalised(text_col).alias("text"))


def streamed_groups(spark: SparkSession, state: str, log: DataFrame, run: int, batches: int) -> DataFrame:
    """For each digest of the run's log: ``first`` (the row that stays), ``place`` (the locator) and ``group_size``.

    The log is a stored table, read as a stream of files. Each micro-batch writes the changed
    states under its own number, so that a repeated batch replaces itself; the last state of a
    digest counts.
    """
    files = len(log.inputFiles())
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(log.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max(1, -(-files // batches))).parquet(f"{state}/log")
        # A locator once retained stays: a later run has a larger number.
        place = F.min(F.struct("row.run", "row.file", "row.number")).alias("place")
        grouped = stream.groupBy("digest").agg(F.min("row").alias("first"), place, F.count("*").alias("group_size"))

        def write(changed: DataFrame, number: int) -> None:
            changed.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{state}/changed/{run}/{number}")

        query = grouped.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{state}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    changed = spark.read.parquet(f"{state}/changed/{run}/*")
    return changed.groupBy("digest").agg(F.max(F.struct("batch", "first", "place", "group_size")).alias("last")).select("digest", "last.first", "last.place", "last.group_size")


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, batches: int = BATCHES, state: str | None = None, run: int = 0) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, digest, and its locator (file, number).

    Texts are equal when they are identical after runs of ASCII white space became one space;
    null counts as empty, and texts of any length are read whole. The row with the smallest id
    stays, null ids last; of rows that repeat that id the first by locator. An empty table gives an
    empty result. Columns of any name may stand beside id and text. ``digest`` may be any function
    of the normalised text: a weak one costs time, not correctness.

    ``state`` names a folder in which the state outlives the call (a fresh one otherwise), and
    ``run`` numbers the calls on it, upwards. A call answers for its own rows, against all rows
    that the state has met; one that failed is repeated under its number and resumes. The files
    that earlier runs read must still be there, as the locators point into them.
    """
    spark = docs.sparkSession
    docs = located(docs)
    state = (state or new_folder(spark, "exact")).rstrip("/")
    row = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.lit(run).alias("run"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("number"))
    path = f"{state}/log/{run}"
    entries = docs.select(row.alias("row"), digest(normalised(text_col)).alias("digest"))
    if not exists(spark, f"{path}/_SUCCESS"):
        entries.write.mode("overwrite").parquet(path)
    log = spark.read.schema(entries.schema).parquet(path)
    if log.isEmpty():
        place = F.min(F.struct("row.run", "row.file", "row.number")).alias("place")
        groups = log.groupBy("digest").agg(F.min("row").alias("first"), place, F.count("*").alias("group_size"))
    else:
        groups = stored(streamed_groups(spark, state, log, run, batches), "groups")

    # Hits, and the rows that the state's locators point to, are fetched by file and row, so that a
    # large group's texts are spread over the tasks; equal ones meet inside each task first.
    many = groups.where("group_size > 1").select("digest", "place")
    at = [F.col(f"row.{c}").alias(c) for c in PLACE]
    is_lead = (F.col("row.run") == F.col("place.run")) & (F.col("row.file") == F.col("place.file")) & (F.col("row.number") == F.col("place.number"))
    hits = log.join(many, "digest").select("digest", *at, is_lead.alias("lead"))
    met = contents(docs, text_col).join(hits, PLACE)
    earlier = many.where(F.col("place.run") < run) if run else None
    if earlier is not None and not earlier.isEmpty():
        # As many names as files hold them, not as rows.
        files = [r.file for r in earlier.select("place.file").distinct().collect()]
        leads = earlier.select("digest", *[F.col(f"place.{c}").alias(c) for c in PLACE], F.lit(True).alias("lead"))
        met = met.unionByName(contents(spark.read.parquet(*files), text_col).join(leads, PLACE).select(met.columns))
    near = met.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(FAN_IN))).groupBy("digest", "text", "part").agg(F.max("lead").alias("lead"))
    texts = near.groupBy("digest", "text").agg(F.max("lead").alias("lead"))
    # What is mixed stays so in later runs.
    texts.where(~F.col("lead")).select("digest").distinct().write.mode("overwrite").parquet(f"{state}/mixed/{run}")
    mixed = spark.read.schema("digest string").option("recursiveFileLookup", "true").parquet(f"{state}/mixed").distinct()

    verdict = [F.col("first.id").alias("keep_id"), "group_size", (F.struct("row.run", *[f"row.{c}" for c in PLACE]) == F.struct("first.run", *[f"first.{c}" for c in PLACE])).alias("kept"), "digest", *at]
    if mixed.isEmpty():
        rows = log.join(groups, "digest")
    else:
        # Several texts under one digest: the rows of all runs are grouped by their text itself.
        all_rows = spark.read.schema(log.schema).option("recursiveFileLookup", "true").parquet(f"{state}/log").join(mixed, "digest", "left_semi")
        files = [r.file for r in all_rows.select("row.file").distinct().collect()]
        own = all_rows.select("digest", "row", *at).join(contents(spark.read.parquet(*files), text_col), PLACE)
        by_text = own.groupBy("digest", "text").agg(F.min("row").alias("first"), F.count("*").alias("group_size"))
        split = own.where(F.col("row.run") == run).join(by_text, ["digest", "text"]).select("row", "digest", "first", "group_size")
        rows = log.join(groups, "digest").join(mixed, "digest", "left_anti").select("row", "digest", "first", "group_size").unionByName(split)
    return rows.select(F.col("row.id").alias(id_col), *verdict)


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``exact_dedup`` drops, found by their locators; all columns stay."""
    docs = located(docs)
    dropped = exact_dedup(docs, id_col, text_col).where(~F.col("kept")).select(*[F.col(c).alias(f"dropped {c}") for c in PLACE])
    own = docs.select("*", F.col("_metadata.file_path").alias("own file"), F.col("_metadata.row_index").alias("own number"))
    gone = (F.col("own file") == F.col("dropped file")) & (F.col("own number") == F.col("dropped number"))
    return own.join(stored(dropped, "dropped"), gone, "left_anti").drop("own file", "own number")


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
