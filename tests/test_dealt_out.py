"""Rows of few bytes and much work are dealt out to many tasks, whatever their files are, and groups do not grow with the texts."""

import os

import pytest
from pyspark.sql import functions as F

from alinea.operators import patterns, relations
from alinea.plans import documents
from alinea.plans.base import Tables


def tasks_with_rows(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_dealt_out(spark):
    rows = spark.range(500).coalesce(1)
    dealt = relations.dealt_out(rows, "id")
    assert tasks_with_rows(rows) == 1 and tasks_with_rows(dealt) == 4 * spark.sparkContext.defaultParallelism
    assert sorted(r.id for r in dealt.collect()) == list(range(500))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables are not here")
@pytest.mark.parametrize("make", [documents.said, documents.drafts, documents.contracts])
def test_rows_of_one_file_are_worked_on_by_many_tasks(spark, make):
    assert tasks_with_rows(make(Tables(spark, "/root/testdata/sf0.001"))) > 4


def test_groups_of_texts_do_not_grow(spark, monkeypatch):
    monkeypatch.setattr(patterns, "GROUP_CHARS", 500)
    docs = spark.createDataFrame([(i, f"text {i} of many") for i in range(400)], "id long, t string")
    library = spark.createDataFrame([(f"text {i} ",) for i in range(0, 400, 7)], "part string")
    found = patterns.found_parts(docs, library, "id", "t", most=16, spread=1)
    assert sorted(r.id for r in found.collect()) == list(range(0, 400, 7))
    sizes = found.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(sizes) > 2
