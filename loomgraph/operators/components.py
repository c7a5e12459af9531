"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.storage import cut


def components(links: DataFrame) -> DataFrame:
    """(id, component) for the ids of links (a, b): the smallest id that each reaches. In turn, every id tells its neighbours the
    least label that it knows, and takes its label's own label; the rounds end when no label changes."""
    ways = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).dropna()
    ids = ways.select(F.col("a").alias("id")).distinct()
    ways = cut(ways.filter("a <> b").distinct())
    now = cut(ids.withColumn("component", F.col("id")))
    while True:
        told = ways.join(now, F.col("a") == F.col("id")).select(F.col("b").alias("id"), "component")
        least = now.unionByName(told).groupBy("id").agg(F.min("component").alias("component"))
        above = now.select(F.col("id").alias("component"), F.col("component").alias("_up"))
        after = cut(least.join(above, "component").select("id", F.least("component", "_up").alias("component")))
        changed = after.join(now.withColumnRenamed("component", "_was"), "id").filter("component <> _was").limit(1).count()
        now = after
        if not changed:
            return now
