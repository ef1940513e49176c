"""Embedding near-dedup by a forest of random-projection trees.

Each tree splits the unit sphere again and again at a random direction's median (of a bounded sample); what lies close to a
split goes to both sides. Vectors are compared within leaves, in double precision, so that no pair below the threshold is
linked; a pair that several leaves share counts in the first one alone. Equal vectors are one class, compared once. A leaf of
more than `block` classes is compared block against block, so that no task gets all of it; links leave a task as counts and as
one edge for each vector, never as pairs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_rows, written
from .links import components


@dataclass(frozen=True)
class Params:
    cosine: float = 0.98
    trees: int = 4
    leaf: int = 96  # classes of the largest label that a leaf has, about
    spill: float = 0.16  # over the root of the dimension, as projections spread: so far from a split, in units of the sphere's radius, a vector goes to both sides
    sample: int = 8192  # bound of the vectors that the splits are fitted on
    fitted: int = 9  # levels that are fitted node by node; deeper ones split at the direction's median over the sample
    block: int = 256
    seed: int = 17


def units(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, float) for v in vectors])
    x /= np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Forest:
    """directions: for each tree depth x dim; splits: for each tree the thresholds of its fitted nodes, by level."""

    def __init__(self, sample: np.ndarray, dim: int, depth: int, p: Params) -> None:
        rng = np.random.default_rng(p.seed)
        self.depth, self.spill = depth, p.spill / math.sqrt(dim)
        self.directions = rng.normal(size=(p.trees, max(depth, 1), dim))
        self.directions /= np.linalg.norm(self.directions, axis=2, keepdims=True)
        self.splits = []
        for tree in range(p.trees):
            at, levels = np.zeros(len(sample), int), []
            for level in range(depth):
                on = sample @ self.directions[tree, level]
                middle = float(np.median(on)) if len(on) else 0.0
                own = np.full(2**level if level < p.fitted else 1, middle)
                if level < p.fitted:
                    for node in range(2**level):
                        if (here := at == node).sum() >= 8:
                            own[node] = np.median(on[here])
                levels.append(own)
                at = 2 * at + (on > own[at if level < p.fitted else 0])
            self.splits.append(levels)

    def leaves(self, x: np.ndarray) -> list[list[int]]:
        """The leaves of each row, in ascending order: tree * 2^40 + path."""
        rows, codes = [], []
        for tree, levels in enumerate(self.splits):
            row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
            for level, own in enumerate(levels):
                off = (x @ self.directions[tree, level])[row] - (own[node] if len(own) > 1 else own[0])
                left, right = off <= self.spill, off >= -self.spill
                row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1])
            rows.append(row)
            codes.append(node + (tree << 40))
        row, code = np.concatenate(rows), np.concatenate(codes)
        order = np.lexsort((code, row))
        ends = np.cumsum(np.bincount(row, minlength=len(x)))[:-1]
        return [c.tolist() for c in np.split(code[order], ends)]


def compare(rows: pd.DataFrame, p: Params) -> pd.DataFrame:
    """One leaf, or two blocks of one: for each class its links found here first, and the smallest class that it is joined to."""
    ids, copies, side = rows["id"].to_numpy(), rows["copies"].to_numpy(), rows["side"].to_numpy()
    x = units(rows["embedding"])
    near = x @ x.T >= p.cosine
    np.fill_diagonal(near, False)
    if rows["across"].iloc[0]:
        near &= side[:, None] != side[None, :]
    here = rows["code"].iloc[0]
    earlier = [[c for c in codes if c < here] for codes in rows["codes"]]
    names = {c: k for k, c in enumerate(dict.fromkeys(c for e in earlier for c in e))}
    first = near
    if names and near.any():
        member = np.zeros((len(ids), len(names)), "float32")
        for i, e in enumerate(earlier):
            member[i, [names[c] for c in e]] = 1
        first = near & (member @ member.T == 0)
    links = first @ copies
    low = ids.copy()
    while True:
        new = np.minimum(low, np.where(near, low[None, :], np.iinfo("int64").max).min(1))
        if (new == low).all():
            break
        low = new
    found = near.any(1)
    return pd.DataFrame({"id": ids[found], "links": links[found], "low": low[found]})


def near_duplicates(embeddings: DataFrame, p: Params = Params()) -> DataFrame:
    """One row per row of embeddings: vec_id, n_links, component_id, kept.

    n_links counts the other vectors of the same label with a cosine of at least p.cosine that share a leaf with it (rows that
    repeat an id count each); component_id is the smallest vec_id reachable, kept says that this is its own. Vectors that are
    null, empty, zero or hold null or non-finite components, and those of a null label or id, link with nothing (with a null
    id, component_id and kept are null). Vectors of different lengths are never compared. Other columns are not read.
    """
    e = F.col("embedding")
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & e.isNotNull() & (F.size("embedding") > 0) & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(e, lambda v: v != 0)
    keyed = embeddings.select("vec_id", "label", "embedding", F.coalesce(sound, F.lit(False)).alias("sound"))
    keyed = keyed.withColumn("k1", F.when(F.col("sound"), F.xxhash64(F.lit(1), "label", e))).withColumn("k2", F.when(F.col("sound"), F.xxhash64(F.lit(2), "label", e)))
    classes = keyed.filter("sound").groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.min(F.struct("vec_id", "label", "embedding")).alias("x"))
    classes = written(classes.select("k1", "k2", "copies", F.col("x.vec_id").alias("id"), F.col("x.label").alias("label"), "x.embedding", F.size("x.embedding").alias("dim")), "classes")
    sizes = classes.groupBy("dim", "label").count().groupBy("dim").agg(F.max("count").alias("most")).collect()  # a row for each length
    parts = []
    for dim, most in sizes:
        own = classes.filter(F.col("dim") == dim)
        drawn = own.orderBy(F.xxhash64(F.lit(p.seed), "id"), "id").limit(p.sample).select("embedding").collect()
        depth = max(0, min(30, math.ceil(math.log2(max(1, most / p.leaf)))))
        forest = classes.sparkSession.sparkContext.broadcast(Forest(units([r.embedding for r in drawn]), dim, depth, p))

        def route(forest=forest):
            return lambda batch: pd.DataFrame({"id": batch["id"], "codes": forest.value.leaves(units(batch["embedding"]))})

        parts.append(map_rows(own.select("id", "embedding"), "id long, codes array<bigint>", route))
    done = keyed.select("vec_id", "k1", "k2")
    if not parts:
        return done.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.when(F.col("vec_id").isNotNull(), True).alias("kept"))
    routed = parts[0]
    for part in parts[1:]:
        routed = routed.unionByName(part)
    routed = written(routed.join(classes.drop("k1", "k2"), "id"), "routed")
    placed = routed.select("id", F.xxhash64("label", "dim").alias("tribe"), F.explode("codes").alias("code"))
    counts = written(placed.groupBy("tribe", "code").agg(F.count("*").alias("size")).filter("size > 1"), "leaves")
    parts_of = F.ceil(F.col("size") / p.block).cast("int")
    dealt = placed.join(counts, ["tribe", "code"]).withColumn("blocks", F.when(F.col("size") > p.block, parts_of).otherwise(1)).withColumn("side", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group = F.xxhash64("tribe", "code", F.least("side", "other"), F.greatest("side", "other"))
    # a class meets its own block once, and each other block in the group of the two
    groups = dealt.select("id", "code", "side", group.alias("group"), (F.col("side") != F.col("other")).alias("across"))
    members = groups.join(routed.select("id", "codes", "copies", "embedding"), "id")

    def each(rows: pd.DataFrame) -> pd.DataFrame:
        return compare(rows, p)

    found = written(members.groupBy("group").applyInPandas(each, "id long, links long, low long"), "found")
    joined = components(found.select(F.col("id").alias("a"), F.col("low").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    known = classes.select("k1", "k2", "copies", "id").join(links, "id", "left").join(joined, "id", "left")
    known = known.select("k1", "k2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    for old in (routed, counts):
        discard(old)
    out = done.join(known, ["k1", "k2"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
