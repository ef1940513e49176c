"""Embedding whitening: the covariance of exactly centred rows by MLlib's RowMatrix, its eigenvectors, whitened coordinates.

Entries are taken to whole numbers, so that their sums are exact and n * x - S is centred without rounding. The Gramian of the
centred rows is summed over the cluster as one triangle of dim * dim numbers; only that and the sums come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_kinds, map_rows, slices, written

SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Params:
    components: int = 32
    scale: int = 64
    shift: int = 1_000_000
    largest: float = 2.0**30  # of an entry: beyond it whole numbers would not fit


def is_sound(vector: str, largest: float) -> Column:
    e = F.col(vector)
    return F.coalesce(e.isNotNull() & (F.size(vector) > 0) & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) <= largest)), F.lit(False))


def matrix_of(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """The vectors of a batch, all of one length, as rows of a matrix."""
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def whole(x: np.ndarray, p: Params) -> np.ndarray:
    return np.floor(p.scale * x.astype(float)).astype("int64") + p.shift


def sums_of(vectors: DataFrame, p: Params) -> list[tuple[int, int, list[int]]]:
    """(dim, n, exact sums of the whole numbers) for each length of vectors: a task adds up its own rows first."""
    schema = "dim int, pos int, n long, total decimal(38,0)"
    kinds = arrow_kinds(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for some in slices(batch):
                dims = some.column("dim").to_numpy()
                for dim in np.unique(dims).tolist():
                    x = whole(matrix_of(some.filter(pa.array(dims == dim)), "embedding"), p)
                    n, total = held.get(dim, (0, [0] * dim))
                    held[dim] = n + len(x), [a + b for a, b in zip(total, x.sum(0).tolist(), strict=True)]
        for dim, (n, total) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim] * dim, "int32"), pa.array(range(dim), "int32"), pa.array([n] * dim, "int64"), pa.array(total, kinds.field("total").type)], schema=kinds)

    added = vectors.mapInArrow(run, schema).groupBy("dim", "pos").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    out: dict[int, list] = {}
    for r in added.collect():  # a row for each dimension
        out.setdefault(r.dim, []).append((r.pos, int(r.n), int(r.total)))
    return [(dim, rows[0][1], [t for _, _, t in sorted(rows)]) for dim, rows in sorted(out.items())]


def covariance(rows: DataFrame, column: str, n: int) -> np.ndarray:
    """Gramian of the rows, which are centred, over n: MLlib adds it up in the JVM."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(F.col(column)).alias("v")), "v")
    return RowMatrix(vectors).computeGramianMatrix().toArray() / n


def directions(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as columns; the largest entry of each is positive."""
    values, vectors = np.linalg.eigh((v + v.T) / 2)
    values, vectors = np.maximum(values[::-1][:most], 0), vectors[:, ::-1][:, :most]
    turn = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    return values, vectors * np.where(turn == 0, 1, turn)


def of_length(vectors: DataFrame, dim: int, n: int, sums: list[int], p: Params) -> DataFrame:
    """The vectors of one length; they are their own list to fit on."""
    own = vectors.filter(F.col("dim") == dim)
    total = F.lit(sums)
    centred = F.zip_with("embedding", total, lambda c, s: (n * (F.floor(p.scale * c.cast("double")) + p.shift) - s).cast("double") / n)
    v = covariance(own.select(centred.alias("c")), "c", n)
    values, vectors_ = directions(v, p.components)
    known = values > (values[0] if len(values) else 0) * dim * np.finfo(float).eps  # the others are noise: nothing varies there
    weights = np.where(known, vectors_ / np.sqrt(np.where(known, values, 1)), 0.0)
    told = own.sparkSession.sparkContext.broadcast((np.array(sums, "int64"), weights))

    def fn():
        sums_, w = told.value
        most = np.iinfo("int64").max

        def each(batch):
            off = n * whole(np.vstack(batch["embedding"].to_numpy()), p) - sums_
            wide = np.abs(off.astype(float)).max(1, initial=0) ** 2 * off.shape[1] > most / 4
            deviation = (off * np.where(wide, 0, 1)[:, None]) ** 2
            exact = deviation.sum(1).tolist()
            for i in np.flatnonzero(wide).tolist():
                big = sum(int(o) ** 2 for o in off[i])
                exact[i] = big if big <= most else None
            out = batch[["vec_id"]].copy()
            out["vec_id"] = out["vec_id"].astype("Int64")
            out["deviation"] = np.array(exact, dtype=object)
            out["y"] = list((off / n) @ w)
            return out

        return each

    coordinates = written(map_rows(own.select("vec_id", "embedding"), "vec_id long, deviation long, y array<double>", fn), "whitened")
    k = weights.shape[1]
    means = coordinates.select(*[F.avg(F.col("y")[i]).alias(f"m{i}") for i in range(k)]).first()
    error = 0.0
    if known.any():
        again = covariance(coordinates.select(F.zip_with("y", F.lit([float(m) for m in means]), lambda y, m: y - m).alias("c")), "c", n)
        error = float(np.abs(again - np.eye(k))[np.ix_(known, known)].max())
    trace = float(np.trace(v))
    explained = [float(e / trace) if trace > 0 else 0.0 for e in values]
    out = coordinates.select("vec_id", "deviation", F.posexplode("y").alias("at", "whitened"))
    return out.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(F.lit(explained), F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )


def whiten(embeddings: DataFrame, p: Params = Params()) -> DataFrame:
    """For each row with a sound vector and each component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or empty, or holds null, non-finite or absurd entries (over p.largest) are left out; a null vec_id
    stays null; rows that repeat count and come out each. Vectors of another length are whitened among themselves. Components
    in which nothing varies (all of them, where all vectors are equal) have whitened 0 and stay out of identity_error, as does
    a share of no variance, 0. deviation is null where it does not fit a long. An empty table gives an empty one; other columns
    are not read.
    """
    sound = embeddings.filter(is_sound("embedding", p.largest)).select("vec_id", "embedding", F.size("embedding").alias("dim"))
    out = None
    for dim, n, sums in sums_of(sound, p):
        part = of_length(sound, dim, n, sums, p)
        out = part if out is None else out.unionByName(part)
    return embeddings.sparkSession.createDataFrame([], SCHEMA) if out is None else out
