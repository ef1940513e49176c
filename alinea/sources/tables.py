"""Reading and writing: Parquet tables, files as bytes, and JSON exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alinea.config import DEFAULT, Config
from alinea.functions.text import is_dirty_page

MAX_FILE_BYTES = 50 * 1024 * 1024  # fixed value: cap of a file


def parquet(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """Files that begin as a PDF and are not over the cap; what extracts their text is plugged in with mapInPandas."""
    files = spark.read.format("binaryFile").load(path)
    return files.filter((F.col("length") <= MAX_FILE_BYTES) & (F.substring(F.col("content"), 1, 4) == F.lit(b"%PDF")))


def page_ranges(pages: Column, size: int = 5) -> Column:
    """[first, end) of each run of `size` pages."""
    starts = F.when(pages > 0, F.sequence(F.lit(0), pages - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(s.alias("first"), F.least(s + size, pages).alias("end")))


def route(chars: Column, pages: Column, least: int = 100) -> Column:
    """The text layer if it has `least` characters a page, else recognition."""
    return F.when(chars / F.greatest(pages, F.lit(1)) >= least, "layout").otherwise("ocr")


def picked_text(current: Column, ocr: Column, hybrid: bool = False, cfg: Config = DEFAULT) -> Column:
    """Recognised text only if longer; hybrid: if at least as long, 80 characters or more, and clean."""
    now, new = F.coalesce(current, F.lit("")), F.coalesce(ocr, F.lit(""))
    better = (F.length(new) >= F.greatest(F.lit(80), F.length(now))) & ~is_dirty_page(new, cfg) if hybrid else F.length(new) > F.length(now)
    return F.when(better, new).otherwise(now)


def joined_pages(df: DataFrame, key: str, page: str, text: str) -> DataFrame:
    """Texts of pages in order, each under a mark of its number."""
    parts = F.array_sort(F.collect_list(F.struct(page, text)))
    mark = F.transform(parts, lambda p: F.concat(F.lit("--- PAGE "), p[page].cast("string"), F.lit(" ---\n"), F.coalesce(p[text], F.lit(""))))
    return df.groupBy(key).agg(F.array_join(mark, "\n\n").alias("text"))


def joined_chunks(df: DataFrame, key: str, first: str, last: str, text: str) -> DataFrame:
    """Texts of page ranges in order, each under a mark of its pages."""
    parts = F.array_sort(F.collect_list(F.struct(first, last, text)))
    mark = F.transform(parts, lambda p: F.concat(F.lit("--- PAGES "), p[first].cast("string"), F.lit("-"), p[last].cast("string"), F.lit(" ---\n"), F.coalesce(p[text], F.lit(""))))
    return df.groupBy(key).agg(F.array_join(mark, "\n\n").alias("text"))


def json_export(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def imported(rows: DataFrame, *required: str) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad ones (a required column is null), which an import skips and reports."""
    bad = F.lit(False)
    for c in required:
        bad = bad | F.col(c).isNull()
    return rows.filter(~bad), rows.filter(bad)


def without_vectors(df: DataFrame, column: str = "embedding") -> DataFrame:
    return df.withColumn(column, F.lit(None).cast(df.schema[column].dataType))
