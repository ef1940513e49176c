"""Which parts of a library occur in which texts, by an automaton of many patterns (goto and failure links) that texts stream past.

A library within bounds is broadcast and texts stay where they are. For a larger one texts are dealt to buckets of bounded size, each
once; a task holds a bucket, and the library streams past it, in automata of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


GROUP_CHARS = 16_000_000  # of the texts that a task holds at a time where a library streams past them
SHARE_PARTS, SHARE_CHARS = 100_000, 8_000_000  # that one automaton takes there


def automaton(patterns: list[str]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for p in patterns:
        if p:
            out.add_word(p, p)
    out.make_automaton()
    return out


def first_places(machine: ahocorasick.Automaton, empty: bool, text: str) -> dict[str, int]:
    """Each pattern that the text has, and its first place, from 1; the empty pattern is at 1."""
    found = {"": 1} if empty else {}
    if len(machine):
        for end, p in machine.iter(text):
            if p not in found:
                found[p] = end - len(p) + 2
    return found


def found_parts(docs: DataFrame, library: DataFrame, key: str, text: str, most: int = 100_000, most_chars: int = 8_000_000, spread: int = 64) -> DataFrame:
    """key, part, at: for each row of docs the distinct parts (library.part) that its text has, and the first place of each.

    Null texts and null parts match nothing. Up to `most` parts of `most_chars` characters are broadcast. Of a larger library each of
    `spread` buckets of texts, or of as many as GROUP_CHARS asks for, gets a copy: texts, which are more, are shuffled once.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    parts = library.select("part").filter(F.col("part").isNotNull()).distinct()
    n, chars = parts.agg(F.count("*"), F.coalesce(F.sum(F.length("part")), F.lit(0))).first()
    out = StructType.fromDDL(f"key {dict(rows.dtypes)['key']}, part string, at long")
    kinds = to_arrow_schema(out)

    def batch_of(keys: list, found: list[tuple[str, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, kinds[0].type), pa.array([p for p, _ in found], pa.string()), pa.array([a for _, a in found], "int64")], schema=kinds)

    def searched(batch: pa.RecordBatch, machine, empty: bool) -> Iterator[pa.RecordBatch]:
        keys, found = [], []
        for k, t in zip(batch.column("key").to_pylist(), batch.column("text"), strict=True):
            hits = first_places(machine, empty, t.as_py())
            keys += [k] * len(hits)
            found += hits.items()
            if len(keys) > 50_000:
                yield batch_of(keys, found)
                keys, found = [], []
        yield batch_of(keys, found)

    if n <= most and chars <= most_chars:
        told = docs.sparkSession.sparkContext.broadcast([r.part for r in parts.collect()])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine, empty = automaton(told.value), "" in told.value
            for batch in batches:
                yield from searched(batch, machine, empty)

        return rows.mapInArrow(run, out).withColumnRenamed("key", key)

    buckets = -(-rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] // GROUP_CHARS)
    spread = max(spread, buckets)
    right = rows.withColumn("bucket", F.pmod(F.xxhash64("key", "text"), F.lit(spread))).withColumn("is_part", F.lit(False))
    left = parts.withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spread - 1).cast("long")))).withColumn("is_part", F.lit(True))
    both = left.unionByName(right, allowMissingColumns=True).select("bucket", "is_part", "part", "key", "text")
    dealt = both.repartition(2 * spread, "bucket").sortWithinPartitions("bucket", "is_part")  # twice as many tasks: buckets of one hash share a task

    def matched(held: dict[str, list], share: list[str]) -> Iterator[pa.RecordBatch]:
        machine, empty = automaton(share), "" in share
        keys, found = [], []
        for text, of in held.items():
            hits = first_places(machine, empty, text)
            for k in of if hits else ():
                keys += [k] * len(hits)
                found += hits.items()
                if len(keys) > 50_000:
                    yield batch_of(keys, found)
                    keys, found = [], []
        yield batch_of(keys, found)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, share, chars = None, {}, [], 0
        for batch in batches:
            for now, part, key, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "part", "key", "text")), strict=True):
                if now != bucket:
                    if held and share:
                        yield from matched(held, share)
                    bucket, held, share, chars = now, {}, [], 0
                if part is None:
                    held.setdefault(text, []).append(key)  # texts that are the same are held and read once
                elif held:
                    if len(share) >= SHARE_PARTS or (share and chars + len(part) > SHARE_CHARS):
                        yield from matched(held, share)
                        share, chars = [], 0
                    share.append(part)
                    chars += len(part)
        if held and share:
            yield from matched(held, share)

    return dealt.mapInArrow(walk, out).withColumnRenamed("key", key)


def found_items(docs: DataFrame, items: DataFrame, key: str, text: str, part: str, **bounds) -> DataFrame:
    """key, the columns of items without part, at: each row of items whose part a text has, and the first place (from 1) of it."""
    named = items.withColumnRenamed(part, "part")
    hits = found_parts(docs, named, key, text, **bounds)
    return hits.join(named, "part").select(key, *[c for c in named.columns if c != "part"], "at")
