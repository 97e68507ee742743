"""A player of recorded sessions: a streaming program is fed what was recorded and has to give what was recorded.

A step of a session is a run of recorded inputs with the outputs recorded after it. One stream plays
all sessions side by side, a step in each micro-batch: the batch's outputs are held against the
recorded ones, and only then the next inputs are released, for the sessions that still agree. All
that a play knows lies in its folder, so it goes on from there after a restart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.operators.filters import stable_json


def steps(entries: DataFrame) -> DataFrame:
    """Inputs and outputs (session, seq, dir, payload) with ``step``: an input that follows an output begins a new one.

    Other entries are left out. Entries of one ``seq`` are taken inputs first, then by payload. An
    output that nothing precedes belongs to a step without inputs.
    """
    order = Window.partitionBy("session").orderBy("seq", "dir", "payload")
    begins = F.coalesce((F.col("dir") == "in") & (F.lag("dir").over(order) == "out"), F.lit(False))
    own = entries.where(F.col("dir").isin("in", "out")).select("session", "seq", "dir", "payload").withColumn("begins", begins)
    return own.withColumn("step", F.sum(F.col("begins").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("begins")


def _written(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    return rows.withColumn("i", F.row_number().over(Window.partitionBy("session").orderBy(*order)))


class Player:
    """Plays recorded ``entries`` (session, seq, dir, payload) to a program, in a folder that driver and executors share.

    The program takes a stream (session, seq, payload) of inputs and gives one (session, seq, part,
    payload) of outputs: those of a session are ordered by the input they follow and ``part``. A
    null session plays no part. Outputs are compared as JSON without ``volatile`` keys.
    """

    def __init__(self, entries: DataFrame, folder: str, volatile: list[str] | None = None):
        self.spark, self.folder, self.volatile = entries.sparkSession, folder, volatile
        if not _written(self.spark, f"{folder}/recorded"):
            rows = steps(entries.where("session IS NOT NULL"))
            stable = stable_json(F.when(F.col("dir") == "out", F.col("payload")), volatile)
            rows = rows.withColumn("payload", F.when(F.col("dir") == "in", F.col("payload")).otherwise(stable))
            rows.write.mode("overwrite").partitionBy("step").parquet(f"{folder}/recorded")
        kept = entries.select("session", "seq", "dir", "payload", F.lit(0).cast("long").alias("step")).schema
        self.recorded = self.spark.read.schema(kept).parquet(f"{folder}/recorded")
        self.inputs = self.recorded.select("session", "seq", "payload").schema

    def _entries(self, step: int) -> DataFrame:
        """What was recorded at a step for the sessions that agree so far."""
        rows = self.recorded.where(F.col("step") == step).drop("step")
        if step == 0:
            return rows
        agreed = self.spark.read.parquet(f"{self.folder}/verdicts/step={step - 1}").where("reason IS NULL")
        return rows.join(agreed, "session", "left_semi")

    def _release(self, step: int) -> None:
        rows = self._entries(step).where("dir = 'in'").select("session", "seq", "payload")
        if step == 0 or not rows.isEmpty():
            rows.write.mode("overwrite").parquet(f"{self.folder}/in/{step}")

    def _judge(self, batch: DataFrame, step: int) -> None:
        """Hold a step's outputs against the recorded ones, then release the next step. Running it again changes nothing."""
        entries = self._entries(step)
        given = _numbered(batch, "seq", "part").select("session", "i", F.lit(True).alias("given"), stable_json(F.col("payload"), self.volatile).alias("got"))
        wanted = _numbered(entries.where("dir = 'out'"), "seq").select("session", "i", F.lit(True).alias("wanted"), "seq", "payload")
        reason = F.when(F.col("given").isNull(), "missing").when(F.col("wanted").isNull(), "surplus").when(~F.col("got").eqNullSafe(F.col("payload")), "payload")
        rows = given.join(wanted, ["session", "i"], "full_outer").withColumn("reason", reason)
        bad = F.min(F.when(F.col("reason").isNotNull(), F.struct("i", "reason", "seq"))).alias("bad")
        by = rows.groupBy("session").agg(bad, F.count("*").alias("n"))
        fed = entries.groupBy("session").agg(F.count_if(F.col("dir") == "in").alias("fed"))
        matched = F.coalesce(F.col("bad.i") - 1, F.col("n"), F.lit(0)).cast("long")
        verdict = fed.join(by, "session", "left").select("session", "fed", matched.alias("matched"), "bad.reason", "bad.seq")
        verdict.write.mode("overwrite").parquet(f"{self.folder}/verdicts/step={step}")
        self._release(step + 1)

    def play(self, program: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Play to the end, or on to the end after a restart; one row a session.

        ``status`` is reproduced, or diverged with the reason (payload, missing, surplus) and the
        ``seq`` of the recorded output that wasn't given; ``steps`` and ``fed`` count what was played
        until then, ``matched`` the outputs that agreed before.
        """
        spark, folder = self.spark, self.folder
        if not _written(spark, f"{folder}/in/0"):
            self._release(0)
        # A batch is a step: none may come without new inputs, and each folder of inputs is complete when it is listed.
        empty = "spark.sql.streaming.noDataMicroBatches.enabled"
        before = spark.conf.get(empty)
        spark.conf.set(empty, "false")
        try:
            stream = program(spark.readStream.schema(self.inputs).parquet(f"{folder}/in/*"))
            running = stream.writeStream.foreachBatch(self._judge).option("checkpointLocation", f"{folder}/state").start()
        finally:
            spark.conf.set(empty, before)
        try:
            running.processAllAvailable()
        finally:
            running.stop()
        return self.verdicts()

    def verdicts(self) -> DataFrame:
        rows = self.recorded.groupBy("session").agg(*[F.lit(0).cast(t).alias(c) for c, t in (("fed", "long"), ("matched", "long"), ("reason", "string"), ("seq", "long"), ("step", "long"))]).where("false")
        if _written(self.spark, f"{self.folder}/verdicts/step=0"):
            rows = self.spark.read.parquet(f"{self.folder}/verdicts")
        last = F.max(F.struct("step", "reason", "seq")).alias("l")
        by = rows.groupBy("session").agg(last, F.count("*").alias("steps"), F.sum("fed").alias("fed"), F.sum("matched").alias("matched"))
        status = F.when(F.col("l.reason").isNull(), "reproduced").otherwise("diverged")
        return by.select("session", status.alias("status"), "l.reason", "l.seq", "steps", "fed", "matched")
