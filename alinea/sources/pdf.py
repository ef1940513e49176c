"""Intake of PDF documents: requests and files with their checks, and their pages by a reader that is plugged in.

What is wrong with a document is a value beside it, not an error of the job. Files are read by Spark, from whatever store it
can open, or come in requests; a file is one unit of work and has at most 50 MB.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alinea.sources.tables import MAX_FILE_BYTES

REQUEST = "storage_path string, pdf_url string, pdf_base64 string"
EMPTY, TOO_LARGE, NO_PDF, NO_FILE, NO_FETCH = "empty", "too large", "not a PDF", "no such file", "no fetching of addresses"

#: From a file's bytes to the texts of its pages.
Reader = Callable[[bytes], list[str]]


def problem_of(content: Column, most: int = MAX_FILE_BYTES) -> Column:
    """What speaks against reading these bytes; null if nothing."""
    return F.when(F.coalesce(F.octet_length(content), F.lit(0)) == 0, EMPTY).when(F.octet_length(content) > most, TOO_LARGE).when(F.substring(content, 1, 4) != F.lit(b"%PDF"), NO_PDF)


def files(spark: SparkSession, path: str, most: int = MAX_FILE_BYTES) -> DataFrame:
    """path, content, problem of the files below a path; bytes over the cap are not loaded. Spark lists no files without bytes."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small = rows.filter(F.col("length") <= most).select("path", "content", problem_of(F.col("content"), most).alias("problem"))
    large = rows.filter(F.col("length") > most).select("path", F.lit(None).cast("binary").alias("content"), F.lit(TOO_LARGE).alias("problem"))
    return small.unionByName(large)


def requested(requests: DataFrame, key: str, body: str, stored: DataFrame, most: int = MAX_FILE_BYTES) -> DataFrame:
    """key, content, problem of each request: JSON with a storage path, an address or base64 (the first that is given counts), or raw bytes.

    stored: path, content, problem. body is a string of JSON or binary; what is neither JSON nor a PDF is not a PDF, bytes that
    are no base64 as well. An address needs a fetch of its own: it is only told.
    """
    raw = F.col(body) if dict(requests.dtypes)[body] == "binary" else F.encode(F.col(body), "utf-8")
    asked = F.from_json(F.when(~F.coalesce(F.substring(raw, 1, 4) == F.lit(b"%PDF"), F.lit(False)), F.try_to_binary(raw, F.lit("utf-8")).cast("string")), REQUEST)
    rows = requests.select(key, raw.alias("_raw"), asked.alias("_r"))
    given = lambda name: F.coalesce(F.col(f"_r.{name}"), F.lit("")) != ""
    by_path = rows.withColumn("_path", F.when(given("storage_path"), F.col("_r.storage_path"))).join(stored.select(F.col("path").alias("_path"), F.col("content").alias("_stored"), F.col("problem").alias("_stored_problem"), F.lit(True).alias("_found")), "_path", "left")
    decoded = F.try_to_binary(F.col("_r.pdf_base64"), F.lit("base64"))
    content = F.when(F.col("_path").isNotNull(), F.col("_stored")).when(given("pdf_url"), None).when(given("pdf_base64"), decoded).when(F.substring("_raw", 1, 4) == F.lit(b"%PDF"), F.col("_raw"))
    out = by_path.withColumn("_content", content)
    lacking = F.when(F.col("_path").isNotNull() & F.col("_found").isNull(), NO_FILE).when(F.col("_path").isNotNull(), F.col("_stored_problem")).when(given("pdf_url"), NO_FETCH)
    lacking = lacking.when(F.coalesce(F.octet_length("_raw"), F.lit(0)) == 0, EMPTY).when(F.col("_content").isNull(), NO_PDF).otherwise(problem_of(F.col("_content"), most))
    return out.select(key, F.when(lacking.isNull(), F.col("_content")).alias("content"), lacking.alias("problem"))


def pages(documents: DataFrame, key: str, read: Reader) -> DataFrame:
    """documents: key, content, problem. key, page (from 1), text, problem: a row a page of what can be read.

    A document with a problem, or on which the reader fails, has one row without page and text that says so; one without pages
    has none but that row with the problem "no pages".
    """
    kind = dict(documents.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, content, problem in zip(batch[key], batch["content"], batch["problem"], strict=True):
                texts: list[str] = []
                if not isinstance(problem, str):
                    try:
                        texts, problem = list(read(bytes(content))), None
                    except Exception as e:  # a reader may fail in any way on what it is given
                        problem = f"reader: {type(e).__name__}"
                    if not texts and problem is None:
                        problem = "no pages"
                rows = [(k, n, t or "", None) for n, t in enumerate(texts, 1)] or [(k, None, None, problem)]
                yield pd.DataFrame(rows, columns=[key, "page", "text", "problem"]).astype({"page": "Int32"})

    return documents.select(key, "content", "problem").mapInPandas(run, f"{key} {kind}, page int, text string, problem string")


def plain_pages(content: bytes) -> list[str]:
    """A reader of the simplest files: text behind the first line, a form feed between pages. For tests, and as a pattern for others."""
    return content.split(b"\n", 1)[1].decode("utf-8").split("\f")
