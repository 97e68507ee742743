"""Connected components of links between ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import checkpointed


def components(links: DataFrame) -> DataFrame:
    """For each id in links (a, b): the smallest id that it can reach.

    Labels spread over links, then each label is replaced by the label of its own row, which
    halves the way that is left. Every round is checkpointed; only counts reach the driver.
    """
    edges = checkpointed(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct())
    labels = checkpointed(edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("b")).select("id", F.least("id", "b").alias("c")))
    while True:
        over = edges.join(labels.select(F.col("id").alias("b"), "c"), "b").select(F.col("a").alias("id"), "c", F.lit(None).cast(labels.schema["c"].dataType).alias("old"))
        spread = labels.select("id", "c", F.col("c").alias("old")).union(over).groupBy("id").agg(F.min("c").alias("via"), F.max("old").alias("old"))
        jump = labels.select(F.col("id").alias("via"), F.col("c").alias("further"))
        after = checkpointed(spread.join(jump, "via").select("id", "old", F.least("via", "further").alias("c")))
        labels = after.select("id", "c")
        if after.where("c < old").isEmpty():
            return labels
