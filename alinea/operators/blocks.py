"""A set of queries against a library, block by block: each query meets each block of the library once, in some task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Near = Callable[[pd.DataFrame], pd.DataFrame]


def in_blocks(queries: DataFrame, library: DataFrame, prepare: Callable[[pd.DataFrame], Near], schema: str, block: int, parts: int | None = None, apart: bool = False) -> DataFrame:
    """queries and library: the same columns, an id first. prepare(items of a block) returns what maps frames of queries to rows.

    The library is dealt into blocks of about `block` rows by its ids, the queries into parts. A task holds one block and streams
    the queries of a part past it, so its memory does not grow with either side, and no word or item makes a hot key. What is
    shuffled: each query once for each block, each item once for each part. apart: no pairs of block and part are put together into
    larger tasks because their rows are few.
    """
    blocks = max(1, -(-library.count() // block))
    parts = parts or 4 * int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda df, n: F.pmod(F.xxhash64(df.columns[0]), F.lit(n)).cast("int")
    copied = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    items = library.select(copied(parts).alias("_part"), dealt(library, blocks).alias("_block"), F.lit(0).alias("_asks"), *library.columns)
    asked = queries.select(copied(blocks).alias("_block"), dealt(queries, parts).alias("_part"), F.lit(1).alias("_asks"), *queries.columns)
    rows = asked.select("_block", "_part", "_asks", *queries.columns).union(items.select("_block", "_part", "_asks", *library.columns))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, near = None, [], None
        for batch in batches:
            for group, some in batch.groupby(["_block", "_part"], sort=False):
                if group != now:
                    now, held, near = group, [], None
                here, asking = some[some["_asks"] == 0], some[some["_asks"] == 1]
                if len(here):
                    held.append(here)
                if len(asking):
                    near = near or prepare(pd.concat(held) if held else here)
                    yield near(asking)

    dealt_rows = rows.repartition(blocks * parts, "_block", "_part") if apart else rows.repartition("_block", "_part")
    return dealt_rows.sortWithinPartitions("_block", "_part", "_asks").mapInPandas(run, schema)
