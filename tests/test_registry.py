"""Every registered query with SQL gives DuckDB's rows on the smallest tables; the others run."""

import os

import duckdb
import pytest

from alinea.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


def rows(df):
    def cell(v):
        if str(v) in ("None", "nan", "<NA>", "NaT"):
            return "None"
        return repr(float(v)) if hasattr(v, "__float__") and not isinstance(v, (bool, str)) and type(v).__name__ != "bool_" else str(v)

    return sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_duckdb(spark, duck, name):
    got, want = registry.queries()[name](spark, FOLDER).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, FOLDER).toPandas().shape[1] >= 1


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
