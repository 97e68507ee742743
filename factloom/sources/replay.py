"""Recorded sessions: lines of JSON with a header, and their use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER = "session string, format_version bigint, config_hash string, backends map<string,string>, toolchain map<string,string>"
ENTRY = "session string, seq bigint, dir string, snap_rev bigint, binding string, request_id string, payload string"
#: Versions of the format that can be read; the last one is written.
VERSIONS = (1, 2)


def save(header: DataFrame, entries: DataFrame, path: str) -> None:
    """Write sessions, headers first and entries in order. A session's lines stay together."""
    top = header.withColumn("format_version", F.lit(VERSIONS[-1])).select("session", F.lit(-1).cast("long").alias("seq"), F.to_json(F.struct(F.lit("header").alias("record"), "*")).alias("value"))
    rest = entries.select("session", "seq", F.to_json(F.struct(F.lit("entry").alias("record"), "*")).alias("value"))
    top.unionByName(rest).repartition("session").sortWithinPartitions("session", "seq").select("value").write.mode("errorifexists").text(path)


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Headers and entries; another format version is an error. Version 1 has no bindings."""
    lines = spark.read.text(path).withColumn("record", F.get_json_object("value", "$.record"))
    header = lines.where("record = 'header'").select(F.from_json("value", HEADER).alias("h")).select("h.*")
    checked = F.when(F.col("format_version").isin(*VERSIONS), F.col("format_version")).otherwise(F.raise_error(F.lit("unknown format version")).cast("long"))
    entries = lines.where("record = 'entry'").select(F.from_json("value", ENTRY).alias("e")).select("e.*")
    return header.withColumn("format_version", checked), entries


def record(stream: DataFrame, path: str, checkpoint: str):
    """Append a stream of entries (session, seq, …) as they come; each batch has a directory of its own."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def outputs(entries: DataFrame) -> DataFrame:
    return entries.where("dir = 'out'").select("session", "seq", "payload")
