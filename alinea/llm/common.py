"""What several operators of this subpackage share: reading inputs, tables between steps, text maps."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


LIBC = ctypes.CDLL(None)
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir; in local mode alone one of our own where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "local").split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"{tempfile.gettempdir()}/alinea-checkpoints"
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts lineage and survives lost executors.

    The shuffle files that went into it are removed when it stands, rather than when the driver next collects its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/alinea/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._alinea_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the table of written() once nothing reads it any more."""
    path = getattr(df, "_alinea_path", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def slices(batch: pa.RecordBatch, size: int = 4 << 20, rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about so many bytes at most (one row at least), so that no step holds a whole batch twice."""
    step = max(1, min(rows, batch.num_rows * size // max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def arrow_kinds(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


KEPT: dict = {}


def kept(name, make: Callable):
    """What a Python worker keeps from task to task, for one operator at a time: that of another goes first."""
    if name not in KEPT:
        forget()
        KEPT[name] = make()
    return KEPT[name]


def forget() -> None:
    """Gives back what the worker has kept: it serves other operators next, and its memory counts towards the executor's."""
    if KEPT:
        KEPT.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(LIBC, "malloc_trim"):
        LIBC.malloc_trim(0)


def map_rows(df: DataFrame, schema: str, fn: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], keeps: bool = False) -> DataFrame:
    """Like mapInPandas with a state per task: fn() makes it, what it returns maps a frame. Frames are small, whatever the batches.

    keeps: fn uses kept(), so that its state outlives the task.
    """
    kinds = arrow_kinds(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            forget()
        each = fn()
        for batch in batches:
            for some in slices(batch):
                yield pa.RecordBatch.from_pandas(each(some.to_pandas(integer_object_nulls=True)), schema=kinds, preserve_index=False)
        if not keeps:  # now, as the worker may get no other task and its memory still counts
            del each
            forget()

    return df.mapInArrow(run, schema)


def as_list(array: pa.Array) -> list:
    """A column's values; those of a column of lists of integers are numpy views of the batch."""
    if pa.types.is_list(array.type) and pa.types.is_integer(array.type.value_type):
        values, ends = array.values.to_numpy(zero_copy_only=False), array.offsets.to_pylist()
        return [values[a:b] for a, b in zip(ends, ends[1:], strict=False)]
    return array.to_pylist()


def map_groups(df: DataFrame, key: str, schema: str, fn: Callable[[dict[str, list]], list[tuple]]) -> DataFrame:
    """One call of fn for each value of key (a long), with the group's columns as lists; it returns rows.

    As groupBy(key).applyInPandas, without the cost of a frame for each of many small groups: rows are dealt out and sorted
    by key, and a task walks through them. Memory holds one group and one batch.
    """
    kinds, names = arrow_kinds(schema), df.columns

    def output(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held: dict[str, list] = {n: [] for n in names}
        rows: list[tuple] = []
        for batch in batches:
            for n, column in zip(names, batch.columns, strict=True):
                held[n] += as_list(column)
            cuts = np.flatnonzero(np.diff(np.array(held[key], "int64"))) + 1
            at = 0
            for cut in cuts.tolist():
                rows += fn({n: v[at:cut] for n, v in held.items()})
                at = cut
                if len(rows) >= 10_000:
                    yield output(rows)
                    rows = []
            held = {n: v[at:] for n, v in held.items()}
        if held[key]:
            rows += fn(held)
        if rows:
            yield output(rows)
        held, rows = {}, []
        forget()

    return df.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


BITS = 1 << 26  # of a mark of ids: 8 MB are broadcast at most, whatever the input


def perhaps_among(df: DataFrame, id: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of df whose id may be among ids (a table's column of that name), and those whose id surely is not; null is not.

    ids become bits by their hash, BITS in all, which a broadcast tells to the scan of df. So a join with few ids need not
    shuffle all texts. The more ids there are, the more rows pass as possible; then the join itself decides on all of them.
    """
    place = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(BITS)) + 1
    bits = ids.filter(F.col(id).isNotNull()).select(place(id).alias("p"))
    bits = bits.groupBy(F.bitmap_bucket_number("p").alias("_alinea_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("_alinea_bits"))
    both = df.join(F.broadcast(bits), F.bitmap_bucket_number(place(id)) == F.col("_alinea_bucket"), "left")
    at = F.bitmap_bit_position(place(id)).cast("int")
    byte = F.conv(F.hex(F.substring("_alinea_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    may = F.coalesce(F.getbit(byte, at % 8) == 1, F.lit(False)) & F.col(id).isNotNull()
    return tuple(both.filter(c).drop("_alinea_bucket", "_alinea_bits") for c in (may, ~may))


def held_out(doc_id: Column | str) -> Column:
    """True where crc32 of the id as text leaves no remainder modulo 5; such rows are never learnt from."""
    return F.coalesce(F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string")) % 5 == 0, F.lit(False))


def windows_of(docs: DataFrame, most: int, seed: int) -> DataFrame:
    """doc_id, long, text: one row for each id. Of a text of over `most` characters, which is long, a window chosen by the id's hash."""
    n = F.length("text")
    start = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.greatest(F.lit(1), n - most + 1)) + 1
    rows = docs.filter(F.col("text").isNotNull()).select("doc_id", (n > most).alias("long"), F.substring("text", start.cast("int"), F.lit(most)).alias("text"))
    return rows.groupBy("doc_id").agg(F.min(F.struct("long", "text")).alias("x")).select("doc_id", "x.*")


class Memo(dict):
    """A dict that works out what it lacks. When full, its entries become old; old ones that are not asked for again go next.

    Keys of over `longest` items are worked out each time, so that a count of entries bounds the memory.
    """

    def __init__(self, fn: Callable, most: int, longest: int | None = None) -> None:
        super().__init__()
        self.fn, self.most, self.longest, self.old = fn, most, longest, {}

    def __missing__(self, key):
        if self.longest is not None and len(key) > self.longest:
            return self.fn(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        value = self.old.pop(key, None)
        if value is None:
            value = self.fn(key)
        self[key] = value
        return value
