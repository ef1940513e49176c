"""All registered queries over the driver's tables, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from alinea.plans import documents, relational  # noqa: F401  they register their queries
from alinea.plans.base import QUERIES, SQL, Tables


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences of documents aligned with the library: counts by document and status."""
    return documents.flagship(Tables(spark, folder))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
