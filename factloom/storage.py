"""The folder that driver and executors share, and results that are fixed in it."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where a local session names none.

    On a cluster no machine's own folder will do, so a session without the setting is an error.
    """
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    current = context._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        if context.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="factloom-"))
        current = context._jsc.sc().getCheckpointDir()
    return current.get()


def fixed(df: DataFrame) -> DataFrame:
    """``df``, run once and read from the shared folder from then on."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def scratch(spark: SparkSession):
    """A new folder in the shared one, deleted at the end of the block; what outlives it has to be ``fixed`` inside."""
    path = f"{shared_folder(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
