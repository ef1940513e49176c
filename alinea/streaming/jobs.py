"""Streams of events: each function takes a streaming or a batch frame and gives the same rows for both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def events_stream(spark, folder: str, schema, pattern: str = "*.parquet", per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", pattern).parquet(folder)


def debounced(events: DataFrame, key: str, time: str, gap: str = "15 seconds", late: str = "1 minute") -> DataFrame:
    """One row for each burst of a key's events; a burst ends when nothing comes for the gap."""
    e = events.withWatermark(time, late) if events.isStreaming else events
    burst = F.session_window(time, gap)
    return e.groupBy(key, burst.alias("burst")).agg(F.count("*").alias("n")).select(key, F.col("burst.start").alias("start"), F.col("burst.end").alias("end"), "n")


def tumbling(events: DataFrame, key: str, time: str, width: str = "60 seconds", late: str = "1 minute") -> DataFrame:
    """Events of a key in each window of fixed width: what a limiter of fixed windows counts."""
    e = events.withWatermark(time, late) if events.isStreaming else events
    return e.groupBy(key, F.window(time, width).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def collected(events: DataFrame, key: str, totals: DataFrame) -> DataFrame:
    """totals: key, total (static). Running counts, in update or complete mode: complete once the planned number is reached."""
    counts = events.groupBy(key).agg(F.count("*").alias("done"))
    return counts.join(totals, key).select(key, "done", "total", (F.col("done") >= F.col("total")).alias("complete"))


def in_last(events: DataFrame, key: str, time: str, seconds: int = 60) -> DataFrame:
    """How many of a key's events fall into the seconds up to each: what a limiter of sliding windows sees (batch)."""
    w = Window.partitionBy(key).orderBy(F.col(time).cast("timestamp").cast("double")).rangeBetween(-seconds, 0)
    return events.withColumn("in_last", F.count("*").over(w))


def stalls(events: DataFrame, key: str, time: str, *ties: Column, seconds: int = 180, until: Column | None = None) -> DataFrame:
    """Events of a key after which nothing comes for longer than the limit (batch); the last one counts if `until` is that much later."""
    w = Window.partitionBy(key).orderBy(time, *ties)
    after = F.lead(F.col(time).cast("timestamp")).over(w)
    gap = F.unix_micros(after if until is None else F.coalesce(after, until.cast("timestamp"))) - F.unix_micros(F.col(time).cast("timestamp"))
    return events.withColumn("gap_seconds", gap / 1e6).filter(F.col("gap_seconds") > seconds)


def expired(rows: DataFrame, time: str, now: Column, days: int = 7) -> DataFrame:
    """What a daily purge removes."""
    return rows.filter(F.col(time).isNotNull() & (F.col(time) < now - F.make_interval(days=F.lit(days))))
