"""The best of a library of vectors for each query, by products of blocks as matrices.

The side that is known to fit is told to all tasks, the other is dealt out and streams past it; where neither fits, blocks of both
meet. Products in single precision, with what rounding can take from them, find the pairs that may count; those alone are
worked out in double precision, so no hit is lost or judged by a rounded score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alinea.operators.blocks import in_blocks

CELLS = 1 << 21  # of a matrix of queries and items that is worked on at once
HELD_BYTES = 64 << 20  # of the vectors of a side that is told to all tasks
BLOCK = 65_536  # rows of a block where neither side is told
FIRST = 256  # items that the first product of a query has; each next one has as many as were seen, up to CELLS
DENSE = 16  # a product of which one cell in so many may count is worked out in double precision as a whole


def units(x: np.ndarray) -> np.ndarray:
    x = x.astype(float, copy=False)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


class Side:
    """ids, vectors and labels of some rows (id, vector, label); near has the unit vectors in single precision."""

    def __init__(self, ids, vectors, labels) -> None:
        self.ids, self.labels = np.asarray(ids, "int64"), np.asarray(labels, object)
        self.vectors = np.asarray(vectors).reshape(len(self.ids), -1) if len(self.ids) else np.zeros((0, 0))
        self.near = np.empty(self.vectors.shape, "float32")
        for a in range(0, len(self.ids), 8192):
            with np.errstate(invalid="ignore"):
                self.near[a : a + 8192] = units(self.vectors[a : a + 8192])

    @classmethod
    def of_arrow(cls, table) -> Side:
        column = table.column("vector")
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return cls(table.column("id").to_numpy(), column.flatten().to_numpy(zero_copy_only=False), table.column("label").to_pylist())

    @classmethod
    def of_frame(cls, rows: pd.DataFrame) -> Side:
        return cls(rows["id"], np.stack(rows["vector"]) if len(rows) else [], rows["label"])

    def part(self, a: int, b: int) -> Side:
        out = object.__new__(Side)
        out.ids, out.vectors, out.labels, out.near = self.ids[a:b], self.vectors[a:b], self.labels[a:b], self.near[a:b]
        return out


class Score:
    """What counts: similarities of over `least` that are from `from_boosted` on after what kind does to them.

    "same" lets pairs of one label alone count, "boosted" gives those a tenth more, up to 1; "any" reads no labels.
    """

    def __init__(self, kind: str, least: float, from_boosted: float, factor: float = 1.1) -> None:
        self.kind, self.least, self.from_boosted, self.factor = kind, least, from_boosted, factor

    def lowest(self, floor: np.ndarray) -> np.ndarray:
        """The cosine below which no pair reaches the floor."""
        floor = np.maximum(floor, self.from_boosted)
        return np.maximum(np.minimum(floor, floor / self.factor) if self.kind == "boosted" else floor, self.least)

    def of(self, s: np.ndarray, queries: Side, items: Side, q: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What s counts as, and where it does, for pairs (q, i) of rows."""
        out = s
        if self.kind != "any":
            a = queries.labels[q]
            same = (a == items.labels[i]) & np.not_equal(a, None)
            same = same.astype(bool)
            out = np.where(same, s, -9.0) if self.kind == "same" else np.where(same, np.minimum(1.0, s * self.factor), s)
        return out, (s > self.least) & (out >= self.from_boosted) & (queries.ids[q] != items.ids[i])


def products(queries: Side, items: Side, score: Score, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of queries, rows of items and what counts, for all pairs that count and reach their query's floor, and maybe more."""
    wide = len(items.ids)
    margin = (queries.near.shape[1] + 8) * 1.2e-7  # more than rounding to and in single precision makes of a unit vector's product
    lowest = score.lowest(floor)
    with np.errstate(invalid="ignore"):
        cells = np.flatnonzero(queries.near @ items.near.T >= (lowest - margin).astype("float32")[:, None])
        if len(cells) * DENSE > len(queries.ids) * wide:
            exact = units(queries.vectors) @ units(items.vectors).T
            q, i = np.nonzero(exact >= lowest[:, None])
            s = exact[q, i]
        else:
            q, i = cells // wide, cells % wide
            s = np.empty(len(q))
            for a in range(0, len(q), 65_536):
                some = slice(a, a + 65_536)
                s[some] = np.einsum("ij,ij->i", units(queries.vectors[q[some]]), units(items.vectors[i[some]]))
    out, on = score.of(s, queries, items, q, i)
    return q[on], i[on], out[on]


class Best:
    """The best k items of each query so far: by score rounded to nine digits, then by item."""

    def __init__(self, queries: np.ndarray, k: int) -> None:
        self.queries, self.k = queries, k
        self.floor = np.full(len(queries), -8.0)
        self.held, self.size = [], 0

    def add(self, q: np.ndarray, item: np.ndarray, s: np.ndarray) -> None:
        enough = s >= self.floor[q]
        self.held.append((q[enough], item[enough], s[enough]))
        self.size += int(enough.sum())
        if self.size > 2 * self.k * len(self.queries) + CELLS // 4:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, item, s = (np.concatenate(x) for x in zip(*self.held, strict=True)) if self.held else (np.zeros(0, int), np.zeros(0, "int64"), np.zeros(0))
        order = np.lexsort((item, -np.round(s, 9), q))
        q, item, s = q[order], item[order], s[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == self.k - 1
        self.floor[q[last]] = np.round(s[last], 9) - 1e-9  # what ties with the last, rounded, still counts
        best = place < self.k
        self.held, self.size = [(q[best], item[best], s[best])], int(best.sum())
        return self.held[0]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, item, s = self.cut()
        return self.queries[q], item, s


def met_by(queries: Side, items: Side, score: Score, begin: Callable) -> Iterator[tuple[np.ndarray, ...]]:
    """The rows that begin(ids) gives for one block of queries after the other, each of which has seen all items."""
    high = max(1, min(len(queries.ids), 1024, CELLS // FIRST))
    for a in range(0, len(queries.ids), high):
        asked = queries.part(a, a + high)
        state, b = begin(asked.ids), 0
        while b < len(items.ids):
            c = b + min(max(b, FIRST), max(1, CELLS // high))
            some = items.part(b, c)
            q, i, s = products(asked, some, score, state.floor)
            state.add(q, some.ids[i], s)
            if b < CELLS // high:
                state.cut()  # early floors spare the most
            b = c
        yield state.rows()


def side(df: DataFrame, id: str, vector: str, kind: str) -> DataFrame:
    label = F.lit(None).cast("string") if kind == "any" else F.col("label")
    return df.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("vector"), label.alias("label")).filter(F.col("vector").isNotNull() & F.col("id").isNotNull())


def held(df: DataFrame, most_bytes: int) -> Side | None:
    """The rows of df, if their vectors take no more than so many bytes; one job of at most so many rows as could."""
    first = df.select(F.size("vector")).first()
    if first is None:
        return Side([], [], [])
    most = max(1, most_bytes // (8 * max(1, first[0])))
    if df.limit(most + 1).count() > most:
        return None
    return Side.of_arrow(df.toArrow())


def met(queries: DataFrame, library: DataFrame, score: Score, schema: str, begin: Callable, most_bytes: int, block: int) -> DataFrame:
    """begin(ids of queries) makes what takes (rows of queries, ids of items, scores), knows a floor below which no score counts, and
    gives rows at the end: for each block of queries that has seen the library, or a part of it."""
    names = [f.split()[0] for f in schema.split(", ")]
    context = queries.sparkSession.sparkContext
    tasks = 4 * context.defaultParallelism
    small, some = held(library, most_bytes), held(queries, most_bytes)
    if small is not None and (some is None or len(small.ids) <= len(some.ids)):
        told_items = context.broadcast(small)

        def past_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = told_items.value
            for batch in batches:
                if batch.num_rows and len(items.ids):
                    for rows in met_by(Side.of_arrow(batch), items, score, begin):
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names)

        return queries.repartition(tasks).mapInArrow(past_items, schema)
    if some is not None:
        told = context.broadcast(some)

        def past_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked, high = told.value, 1024
            state = begin(asked.ids)
            for batch in batches:
                if batch.num_rows and len(asked.ids):
                    items = Side.of_arrow(batch)
                    for b in range(0, len(items.ids), CELLS // high):
                        part = items.part(b, b + CELLS // high)
                        for a in range(0, len(asked.ids), high):
                            q, i, s = products(asked.part(a, a + high), part, score, state.floor[a : a + high])
                            state.add(q + a, part.ids[i], s)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in state.rows()], names)

        return library.repartition(tasks).mapInArrow(past_queries, schema)

    def prepare(rows: pd.DataFrame):
        items = Side.of_frame(rows)

        def near(frame: pd.DataFrame) -> pd.DataFrame:
            found = [pd.DataFrame(dict(zip(names, rows, strict=True))) for rows in met_by(Side.of_frame(frame), items, score, begin)]
            return pd.concat(found)

        return near

    parts = max(-(-queries.count() // block), -(-tasks // max(1, -(-library.count() // block))))
    return in_blocks(queries, library, prepare, schema, block, parts, True)


def vector_top_k(queries: DataFrame, library: DataFrame, k: int, least: float, kind: str = "any", from_boosted: float = -8.0, most_bytes: int = HELD_BYTES, block: int = BLOCK) -> DataFrame:
    """queries: q, v; library: item, w (arrays of one length). q, item, similarity, rank. An item is never its own query's hit.

    kind: "any"; "same" or "boosted" need a column label on both sides: those of one label alone count, or get a tenth more, up
    to 1. similarity is over `least` before a boost and at least `from_boosted` after it. Null ids and vectors match nothing.
    """
    pairs = met(side(queries, "q", "v", kind), side(library, "item", "w", kind), Score(kind, least, max(from_boosted, -8.0)), "q long, item long, similarity double", lambda ids: Best(ids, k), most_bytes, block)
    w = Window.partitionBy("q").orderBy(F.desc(F.round("similarity", 9)), "item")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


class Counts:
    """How many pairs each query has, and its best score."""

    def __init__(self, queries: np.ndarray) -> None:
        self.queries, self.n, self.best = queries, np.zeros(len(queries), "int64"), np.full(len(queries), -9.0)
        self.floor = np.full(len(queries), -8.0)

    def add(self, q: np.ndarray, item: np.ndarray, s: np.ndarray) -> None:
        self.n += np.bincount(q, minlength=len(self.queries))
        np.maximum.at(self.best, q, s)

    def cut(self) -> None:
        pass

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        on = self.n > 0
        return self.queries[on], self.n[on], self.best[on]


def vector_counts(queries: DataFrame, library: DataFrame, least: float, most_bytes: int = HELD_BYTES, block: int = BLOCK) -> DataFrame:
    """q, n, best: how many items have a similarity of `least` or more, and the highest one, for queries that have any.

    Hits are counted where they are found: none leaves its task.
    """
    parts = met(side(queries, "q", "v", "any"), side(library, "item", "w", "any"), Score("any", -9.0, least), "q long, n long, best double", Counts, most_bytes, block)
    return parts.groupBy("q").agg(F.sum("n").alias("n"), F.max("best").alias("best"))
