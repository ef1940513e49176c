"""Document fingerprints: one-permutation MinHash with optimal densification, packed to the low-order bits of each bin.

A shingle's hash is taken once: its first bits choose the bin, a bin keeps its smallest hash. An empty bin borrows from a bin
that a fixed random sequence of its own leads to first (the same for all documents). Of each bin `bits` low-order bits are
stored; two unlike bins agree on them by chance, which the likeness corrects for.
"""

from __future__ import annotations

import base64
import hashlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, written
from .jaccard import shingles


@dataclass(frozen=True)
class Params:
    words: int = 5
    bins: int = 256  # a power of two
    bits: int = 8  # 1, 2, 4 or 8
    seed: int = 3


@lru_cache(64)
def donors(bins: int, seed: int, turn: int) -> np.ndarray:
    """bins x 64: where an empty bin looks, in order; after all 64 places those of the next turn follow."""
    return np.random.default_rng([seed, turn]).integers(0, bins, (bins, 64))


def sketch(tokens: np.ndarray, p: Params) -> bytes:
    """tokens: sorted distinct hashes of 63 bits. Packed bits of all bins; nothing for no tokens."""
    if not len(tokens):
        return b""
    where = tokens >> (63 - (p.bins.bit_length() - 1))
    first = np.flatnonzero(np.diff(where, prepend=-1))
    low, full = np.zeros(p.bins, "uint8"), np.zeros(p.bins, bool)
    low[where[first]] = (tokens[first] & ((1 << p.bits) - 1)).astype("uint8")
    full[where[first]] = True
    empty = np.flatnonzero(~full)
    turn = 0
    while len(empty):
        ways = donors(p.bins, p.seed, turn)[empty]
        chosen = ways[np.arange(len(empty)), full[ways].argmax(1)]
        met = full[chosen]
        low[empty[met]] = low[chosen[met]]
        empty, turn = empty[~met], turn + 1
    if p.bits == 8:
        return low.tobytes()
    return np.packbits((low[:, None] >> np.arange(p.bits)[::-1]) & 1).tobytes()


def unpacked(packed: bytes, p: Params) -> np.ndarray:
    if p.bits == 8:
        return np.frombuffer(packed, "uint8")
    return np.unpackbits(np.frombuffer(packed, "uint8")).reshape(p.bins, p.bits) @ (1 << np.arange(p.bits)[::-1])


def likeness(a: bytes, b: bytes, p: Params) -> float:
    """Estimated Jaccard similarity, corrected for chance; 1 for two empty sets, 0 if one is empty."""
    if not a or not b:
        return float(a == b)
    same, chance = float((unpacked(a, p) == unpacked(b, p)).mean()), 2.0**-p.bits
    return min(1.0, max(0.0, (same - chance) / (1 - chance)))


def following(docs: DataFrame) -> DataFrame:
    """doc_id, before, wanted: the id before it in ascending order (for the first: the last), and a quarter of its characters.

    Ranges of ids go to different tasks; only the first and last id of each range meet in one.
    """
    sizes = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce(F.length("text"), F.lit(0))).alias("n"))
    sizes = written(sizes.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()), "order")
    inside = Window.partitionBy("part").orderBy("doc_id")
    near = sizes.select("doc_id", "part", F.lag("doc_id").over(inside).alias("before"), F.lag("n").over(inside).alias("n"))
    ends = sizes.groupBy("part").agg(F.min("doc_id").alias("doc_id"), F.max(F.struct("doc_id", "n")).alias("last"))
    whole = Window.orderBy("doc_id")
    ends = ends.select("doc_id", F.coalesce(F.lag("last").over(whole), F.last("last").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("edge"))
    joined = near.join(ends, "doc_id", "left")
    return joined.select("doc_id", F.coalesce("before", "edge.doc_id").alias("before"), F.expr("coalesce(n, edge.n) div 4").alias("wanted"))


def fingerprints(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """One row per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the document's without its last quarter of characters, followed by as many of the next document.
    Null texts count as empty; empty texts have an empty fingerprint, alike to each other and unlike all else. Rows that
    repeat a doc_id are one document in the order; if their texts differ, the next document is one of them, the same in each
    run. Rows with a null doc_id are kept and have no next document (an empty text). Other columns of docs are not read.
    """

    def first():
        press = zstandard.ZstdCompressor(level=3)

        def each(batch: pd.DataFrame) -> pd.DataFrame:
            texts = [t or "" for t in batch["text"]]
            return pd.DataFrame({
                "doc_id": batch["doc_id"].astype("Int64").to_numpy(dtype=object), "n_chars": [len(t) for t in texts],
                "print": [sketch(shingles(t, p.words), p) for t in texts], "body": [press.compress(t.encode()) for t in texts],
            })

        return each

    def cut():
        press, open_ = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()

        def each(batch: pd.DataFrame) -> pd.DataFrame:
            heads = [press.compress(open_.decompress(b).decode()[:n].encode()) for b, n in zip(batch["body"], batch["wanted"], strict=True)]
            return pd.DataFrame({"doc_id": batch["before"], "head": heads, "next": batch["print"]})

        return each

    def last():
        open_ = zstandard.ZstdDecompressor()

        def one(n: int, own: bytes, body: bytes, head: bytes | None, after: bytes | None):
            text = open_.decompress(body).decode()
            edited = text[: n - n // 4] + (open_.decompress(head).decode() if head is not None else "")
            other = sketch(shingles(edited, p.words), p)
            shown = [base64.b64encode(x).decode() for x in (own, other)]
            return hashlib.sha256(edited.encode()).hexdigest(), *shown, likeness(own, other, p), likeness(own, after or b"", p)

        def each(batch: pd.DataFrame) -> pd.DataFrame:
            columns = ["edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
            out = pd.DataFrame([one(*r) for r in zip(*(batch[c] for c in ("n_chars", "print", "body", "head", "next")), strict=True)], columns=columns)
            out.insert(0, "n_chars", batch["n_chars"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy(dtype=object))
            return out

        return each

    kinds = "doc_id long, n_chars long, print binary, body binary"
    # both joins take the same columns of the same rows, so that these are worked out and dealt out once
    rows = map_rows(docs.select("doc_id", "text").filter("doc_id is not null"), kinds, first).filter("doc_id is not null")
    placed = rows.join(following(docs), "doc_id").select("before", "wanted", "body", "print", "n_chars")
    heads = map_rows(placed, "doc_id long, head binary, next binary", cut)
    heads = heads.groupBy("doc_id").agg(F.min(F.struct("head", "next")).alias("after")).select("doc_id", "after.head", "after.next")
    whole = rows.join(heads, "doc_id", "left")
    alone = map_rows(docs.select("doc_id", "text").filter("doc_id is null"), kinds, first)
    alone = alone.withColumns({"head": F.lit(None).cast("binary"), "next": F.lit(None).cast("binary")})
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return map_rows(whole, schema, last).unionByName(map_rows(alone, schema, last))
