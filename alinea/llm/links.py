"""Connected components of links between ids, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long, not null). Returns id, component (the smallest id reachable) for each id in links.

    Every id points at the smallest id that it has heard of. In a round each id learns what its neighbours point at, tells the
    id that it points at, and then takes over what that one points at, so that paths halve. Tables between rounds are written
    to the shared folder. No group is gathered: all steps are joins that Spark can split and minima that it combines early.
    """
    pairs = links.select("a", "b").filter("a <> b").distinct()
    both = written(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    points = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("to")), "points")
    while True:
        seen = both.join(points.select(F.col("id").alias("b"), "to"), "b").select(F.col("a").alias("id"), "to")
        heard = written(points.unionByName(seen).groupBy("id").agg(F.min("to").alias("to")), "heard")
        told = points.join(heard.withColumnRenamed("to", "new"), "id").select(F.col("to").alias("id"), F.col("new").alias("to"))
        hooked = written(heard.unionByName(told).groupBy("id").agg(F.min("to").alias("to")), "hooked")
        jumped = hooked.join(hooked.select(F.col("id").alias("to"), F.col("to").alias("far")), "to").select("id", F.col("far").alias("to"))
        new = written(jumped, "points")
        changed = new.join(points.withColumnRenamed("to", "old"), "id").filter("to <> old").limit(1).count()
        for old in (points, heard, hooked):
            discard(old)
        points = new
        if not changed:
            discard(both)
            return points.select("id", F.col("to").alias("component"))
