"""Keyed state against the batch functions: events out of order, too late, at one time, over restarts of a checkpoint."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from alinea.streaming import jobs, stateful

START = datetime(2024, 1, 1)
EVENT = "event_id long, user_id long, ts timestamp"


@pytest.fixture(scope="module")
def files(tmp_path_factory, spark):
    """Events of three users, mixed up within five minutes, in files that a stream reads one after the other; the last file ends all waits."""
    rng, rows = random.Random(3), []
    for user in range(3):
        at = 0.0
        for _ in range(25):
            at += rng.choice([0, 5, 59, 60, 61, 180, 181, 400])
            rows.append((len(rows), user, START + timedelta(seconds=at)))
    rows.sort(key=lambda r: (r[2] + timedelta(seconds=rng.randint(0, 300)), r[0]))
    folder = tmp_path_factory.mktemp("events")
    end = max(r[2] for r in rows)
    parts = [rows[k : k + 25] for k in range(0, len(rows), 25)]
    parts += [[(9001, 9, end + timedelta(hours=1))], [(9002, 9, end + timedelta(hours=2))]]
    late = (9100, 0, START)
    parts += [[late, (9003, 9, end + timedelta(hours=3))]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, EVENT).coalesce(1).write.parquet(f"{folder}/{k:03}")
    return folder, rows


def run(spark, folder, job, name, tmp_path):
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))
    q = job(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    q.awaitTermination(240)
    if q.exception():
        raise q.exception()
    return spark.table(name)


def test_stalls(spark, files, tmp_path):
    folder, rows = files
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    got = run(spark, folder, lambda s: stateful.stalls(s, "user_id", "ts", "event_id", late="10 minutes"), "stalled", tmp_path).filter("user_id < 9")
    spark.conf.set("spark.sql.shuffle.partitions", before)
    batch = jobs.stalls(spark.createDataFrame(rows, EVENT), "user_id", "ts", F.col("event_id"), until=F.lit(START + timedelta(days=2)))
    assert sorted((r.user_id, r.event_id, r.ts) for r in got.collect()) == sorted((r.user_id, r.event_id, r.ts) for r in batch.collect())


def test_sliding_counts(spark, files, tmp_path):
    folder, rows = files
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    got = run(spark, folder, lambda s: stateful.in_last(s, "user_id", "ts", "event_id", late="10 minutes"), "sliding", tmp_path).filter("user_id < 9")
    spark.conf.set("spark.sql.shuffle.partitions", before)
    batch = jobs.in_last(spark.createDataFrame(rows, EVENT), "user_id", "ts", 60)
    assert sorted((r.event_id, r.in_last) for r in got.collect()) == sorted((r.event_id, r.in_last) for r in batch.collect())


def test_collector_fires_once_over_a_restart(spark, tmp_path):
    totals = spark.createDataFrame([(0, 4), (1, 9), (2, 3), (3, 0)], "k long, total long")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")

    def once(rows, part):
        spark.createDataFrame(rows, "k long, n long").coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
        stream = spark.readStream.schema("k long, n long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        q = stateful.collected_once(stream, "k", totals).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert q.exception() is None
        return sorted(tuple(r) for r in spark.read.schema("k long, done long, total long").parquet(f"{tmp_path}/out").collect())

    first = once([(0, 1)] * 4 + [(1, 1)] * 3 + [(2, 1)] * 2 + [(7, 1)], "a")
    assert first == [(0, 4, 4)]
    second = once([(0, 1)] * 5 + [(1, 1)] * 2 + [(2, 1)] + [(3, 1)] + [(None, 1)], "b")
    assert second == [(0, 4, 4), (2, 3, 3), (3, 1, 0)]
    spark.conf.set("spark.sql.shuffle.partitions", before)
