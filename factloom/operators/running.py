"""Running sums over a total order of all rows, without all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.storage import fixed


def running_sum(rows: DataFrame, order: list[Column | str], value: Column, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the row and all before it; ``order`` must be total.

    Rows are dealt out by ranges of the order and summed inside each range; the sums of the ranges,
    one row each, give what to add. The ranges are fixed first, as a second run may draw others.
    """
    part, add = "range of running sum", "sum before range"
    parts = fixed(rows.withColumn("value of running sum", value).repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    within = F.sum("value of running sum").over(Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    totals = parts.groupBy(part).agg(F.sum("value of running sum").alias("t"))
    before = totals.select(part, F.coalesce(F.sum("t").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(add))
    return parts.withColumn(out, within).join(F.broadcast(before), part).withColumn(out, F.col(out) + F.col(add)).drop(part, add, "value of running sum")
