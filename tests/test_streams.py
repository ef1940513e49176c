"""The same functions on a stream and on a batch give the same rows."""

from pyspark.sql import functions as F

from alinea.streaming import jobs


def test_collector(spark, tmp_path):
    rows = spark.range(30).select((F.col("id") % 3).alias("k"), (F.lit("2024-01-01").cast("timestamp") + F.make_interval(secs=F.col("id"))).alias("ts"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    totals = spark.createDataFrame([(0, 10), (1, 11), (2, 10)], "k long, total long")
    stream = jobs.collected(jobs.events_stream(spark, str(tmp_path / "in"), rows.schema), "k", totals)
    q = stream.writeStream.outputMode("complete").format("memory").queryName("collected").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = sorted(map(tuple, spark.table("collected").collect()))
    assert got == sorted(map(tuple, jobs.collected(rows, "k", totals).collect())) and [r[3] for r in got] == [True, False, True]


def test_debounce(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0), (1, 10), (1, 40), (2, 5)], "k long, s int").select("k", (F.lit("2024-01-01").cast("timestamp") + F.make_interval(secs=F.col("s"))).alias("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    assert sorted(r.n for r in jobs.debounced(rows, "k", "ts").collect()) == [1, 1, 2]
    stream = jobs.debounced(jobs.events_stream(spark, str(tmp_path / "in"), rows.schema), "k", "ts")
    q = stream.writeStream.outputMode("append").format("memory").queryName("bursts").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {tuple(r) for r in spark.table("bursts").select("k", "n").collect()} <= {(1, 2), (1, 1), (2, 1)}
