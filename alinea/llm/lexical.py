"""Ranked lexical search by MaxScore, shard by shard.

The index is two tables. `postings` has a row for each term of a shard: which of the shard's documents hold it, how often, and
those pairs of occurrences and length that no other posting of the row beats, from which the row's upper bound follows once
the corpus is known. `shards` has a row for each shard: its documents and their lengths. A shard is a few thousand documents
that a task has read, so building shuffles nothing.

A search takes each item's terms to all shards. In a shard, the item's lists are opened by falling upper bound. As soon as the
bounds of all lists that are not open sum to less than the k-th best score so far, no unseen document can qualify: these are
the non-essential lists, and they are only probed, for the documents that can still qualify, fewer after each list.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_kinds, discard, map_groups, perhaps_among, slices, written

#: What stands between terms: the ASCII signs that are neither digits nor letters.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
POSTINGS = "shard long, term string, docs array<int>, occurs array<int>, most array<int>, shortest array<int>"
SHARDS = "shard long, ids array<bigint>, lengths array<int>"
ABSENT = np.iinfo("int64").min  # a null doc_id inside an array of ids


@dataclass(frozen=True)
class Params:
    k: int = 50
    shard: int = 4096  # documents of a shard at most
    terms: int = 2_000_000  # of a shard, with repeats, after which it takes no further document
    items: int = 4096  # searched for together in a shard
    shares: int = 64
    k1: int = 1000  # in thousandths: what the occurrences are weighed by
    k1_rest: int = 20


@dataclass(frozen=True)
class Index:
    postings: DataFrame
    shards: DataFrame
    table: DataFrame  # both as they are written


def terms_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row of each term, the term) of all texts: only A-Z are lower-cased."""
    lists = pc.split_pattern_regex(pc.fill_null(pc.ascii_lower(texts), ""), BETWEEN)
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    terms, rows = pc.list_flatten(lists), pc.list_parent_indices(lists)
    some = pc.greater(pc.binary_length(terms), 0)
    return rows.filter(some).to_numpy().astype("int64"), terms.filter(some)


def best_pairs(occurs: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that no other beats by more occurrences in a document that is no longer: few, and the best score is among theirs."""
    order = np.lexsort((-occurs, lengths))
    o, n = occurs[order], lengths[order]
    first = np.flatnonzero(o > np.concatenate([[0], np.maximum.accumulate(o)[:-1]]))
    return o[first], n[first]


class Shard:
    """Collects documents until it is full."""

    def __init__(self, number: int) -> None:
        self.number, self.ids, self.lengths = number, [], []
        self.rows, self.terms, self.size = [], [], 0

    def add(self, ids: pa.Array, texts: pa.Array) -> None:
        row, terms = terms_of(texts)
        coded = terms.dictionary_encode()
        codes, words = coded.indices.to_numpy().astype("int64"), len(coded.dictionary)
        pairs, occurs = np.unique(row * words + codes, return_counts=True) if words else (np.array([], "int64"), np.array([], "int64"))
        lengths = np.bincount(row, minlength=len(ids))
        self.rows.append((pairs // max(1, words) + len(self.ids), occurs))
        self.terms.append(coded.dictionary.take(pa.array(pairs % max(1, words))))
        self.ids += pc.fill_null(ids, ABSENT).to_pylist()
        self.lengths += lengths.tolist()
        self.size += int(lengths.sum())

    def postings(self, kinds: pa.Schema) -> Iterator[pa.RecordBatch]:
        """By term; of a term, the documents ascend."""
        coded = pa.chunked_array(self.terms, pa.string()).combine_chunks().dictionary_encode()
        codes = coded.indices.to_numpy()
        docs, occurs = (np.concatenate(x) for x in zip(*self.rows, strict=True))
        order = np.lexsort((docs, codes))
        docs, occurs, codes = docs[order].astype("int32"), occurs[order].astype("int32"), codes[order]
        ends = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(coded.dictionary)))])
        lengths = np.array(self.lengths, "int64")
        most, shortest, cuts = [], [], [0]
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            if b - a == 1:
                o, n = occurs[a:b], lengths[docs[a:b]]
            else:
                o, n = best_pairs(occurs[a:b], lengths[docs[a:b]])
            most.append(o)
            shortest.append(n)
            cuts.append(cuts[-1] + len(o))

        def lists(values, offsets, name):
            return pa.ListArray.from_arrays(pa.array(offsets, "int32"), pa.array(values, "int32"), type=kinds.field(name).type)

        if len(coded.dictionary):
            flat = [lists(docs, ends, "docs"), lists(occurs, ends, "occurs"), lists(np.concatenate(most), cuts, "most"), lists(np.concatenate(shortest), cuts, "shortest")]
            whole = pa.RecordBatch.from_arrays([pa.array([self.number] * len(coded.dictionary), "int64"), coded.dictionary, *flat], schema=kinds)
            yield from slices(whole, rows=10_000)


def build(docs: DataFrame, p: Params = Params()) -> Index:
    """The index of whole texts of docs (doc_id, text). Every row is a document of its own, rows that repeat an id and null texts too.

    One pass writes both tables as one, rows of shards beside rows of terms, so that they agree whatever is run again.
    """
    kinds, shard_kinds = arrow_kinds(POSTINGS), arrow_kinds(SHARDS)
    both = f"{POSTINGS}, ids array<bigint>, lengths array<int>"
    out_kinds = arrow_kinds(both)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0

        def padded(batch: pa.RecordBatch) -> pa.RecordBatch:
            own = dict(zip(batch.schema.names, batch.columns, strict=True))
            return pa.RecordBatch.from_arrays([own.get(f.name, pa.nulls(batch.num_rows, f.type)) for f in out_kinds], schema=out_kinds)

        def done(shard: Shard) -> Iterator[pa.RecordBatch]:
            yield padded(pa.RecordBatch.from_arrays([pa.array([shard.number], "int64"), pa.array([shard.ids], shard_kinds.field("ids").type), pa.array([shard.lengths], shard_kinds.field("lengths").type)], schema=shard_kinds))
            for some in shard.postings(kinds):
                yield padded(some)

        shard = Shard(task << 32)
        for batch in batches:
            for some in slices(batch, rows=min(512, p.shard)):
                if shard.ids and (len(shard.ids) + some.num_rows > p.shard or shard.size >= p.terms):
                    yield from done(shard)
                    made += 1
                    shard = Shard(task << 32 | made)
                shard.add(some.column("doc_id"), some.column("text"))
        if shard.ids:
            yield from done(shard)

    table = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, both), "index")
    return Index(table.filter("term IS NOT NULL").select(*kinds.names), table.filter("term IS NULL").select(*shard_kinds.names), table)


def item_terms(items: DataFrame, p: Params) -> DataFrame:
    """item (its number here), block, item_id, terms: one row for each row of items that has a term, each term once."""
    # a written table, as the numbers must not change when a task runs again
    numbered = written(items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), "text"), "items")
    words = F.split(F.translate("text", UPPER, LOWER), BETWEEN)
    terms = F.array_sort(F.array_distinct(F.filter(words, lambda w: w != "")))
    return numbered.select("item", "item_id", terms.alias("terms")).filter(F.size("terms") > 0)


def weight(df: Column, n: Column) -> Column:
    return F.floor(1000 * F.log((2 * n + 2).cast("double") / (2 * df + 1).cast("double"))).cast("long")


class Lists:
    """The posting lists of a shard for the terms of a block of items; what is opened stays worked out for the next items."""

    def __init__(self, lengths: np.ndarray, n: int, total: int, p: Params) -> None:
        self.m = 50 + (50 * lengths.astype("int64") * n) // total
        self.n, self.total, self.p = n, total, p
        self.of: dict[str, tuple] = {}
        self.opened: dict[str, np.ndarray] = {}

    def impact(self, occurs: np.ndarray, m: np.ndarray) -> np.ndarray:
        occurs = occurs.astype("int64")
        return (1_000_000_000 * occurs) // (self.p.k1 * occurs + self.p.k1_rest * m)

    def put(self, term: str, w: int, docs: np.ndarray, occurs: np.ndarray, most: np.ndarray, shortest: np.ndarray) -> None:
        bound = w * int(self.impact(most, 50 + (50 * shortest.astype("int64") * self.n) // self.total).max())
        self.of[term] = bound, w, docs, occurs

    def scores(self, term: str) -> np.ndarray:
        """All of a list's, for its documents."""
        if term not in self.opened:
            _, w, docs, occurs = self.of[term]
            self.opened[term] = w * self.impact(occurs, self.m[docs])
        return self.opened[term]

    def probe(self, term: str, wanted: np.ndarray) -> np.ndarray:
        """The list's score of each wanted document, 0 where it is not there."""
        _, w, docs, occurs = self.of[term]
        at = np.minimum(np.searchsorted(docs, wanted), len(docs) - 1)
        here = docs[at] == wanted
        out = np.zeros(len(wanted), "int64")
        out[here] = w * self.impact(occurs[at[here]], self.m[wanted[here]])
        return out


def kth(scores: np.ndarray, k: int) -> int:
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


def best_of(terms: list[str], lists: Lists, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents (places in the shard) that may be among the item's k best, with their whole scores: all with the k-th best score too."""
    own = sorted((t for t in terms if t in lists.of), key=lambda t: (-lists.of[t][0], t))
    rest = np.concatenate([np.cumsum([lists.of[t][0] for t in own][::-1])[::-1], [0]]).astype("int64") if own else np.zeros(1, "int64")
    sums = np.zeros(len(lists.m), "int64")
    floor, at = 0, 0
    while at < len(own) and rest[at] >= floor:  # essential: a document that is only in lists from here on can still qualify
        sums[lists.of[own[at]][2]] += lists.scores(own[at])
        at += 1
        floor = kth(sums, k)
    wanted = np.flatnonzero(sums + rest[at] >= max(floor, 1)) if at < len(own) else np.flatnonzero(sums >= max(floor, 1))
    found = sums[wanted]
    while at < len(own):
        found = found + lists.probe(own[at], wanted)
        at += 1
        floor = max(floor, kth(found, k))
        able = found + rest[at] >= max(floor, 1)
        wanted, found = wanted[able], found[able]
    return wanted, found


def search(index: Index, items: DataFrame, p: Params = Params()) -> DataFrame:
    """One row for each of the best p.k documents of each row of items: item_id, rank, doc_id, score, by score and ascending doc_id.

    Items without a term (null and empty texts too) find nothing, as do terms that no document holds; fewer rows come out where
    fewer documents score above 0. A null item_id stays null, and rows that repeat an item are searched for each. A document of
    a null doc_id counts and is found, after those of its score. An empty index or no items give an empty result. Other columns
    are not read.
    """
    asked = written(item_terms(items, p), "asked")
    totals = index.shards.select(F.explode("lengths").alias("n")).filter("n > 0").agg(F.count("*").alias("n"), F.sum(F.col("n").cast("long")).alias("total")).first()
    n, total = totals.n, totals.total or 0
    schema = "item long, item_id long, doc_id long, score long"
    count = asked.count()
    blocks = max(1, -(-count // p.items))
    block = F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int")
    # only lists of the items' terms are read; a broadcast filter of bounded size keeps the others out before the join
    terms = asked.select(F.explode("terms").alias("term"), block.alias("block")).distinct().withColumn("mark", F.xxhash64("term"))
    may, _ = perhaps_among(index.postings.withColumn("mark", F.xxhash64("term")), "mark", terms.select("mark").distinct())
    hits = written(may.drop("mark").join(terms.drop("mark"), "term"), "hits")
    known = hits.groupBy("block", "term").agg(F.sum(F.size("docs").cast("long")).alias("df")).select("block", "term", weight(F.col("df"), F.lit(n)).alias("w"))
    group = F.col("shard") * blocks + F.col("block")
    lists = hits.join(known, ["block", "term"]).select(
        group.alias("key"), F.lit(1).alias("kind"), "term", "w", "docs", "occurs", "most", "shortest",
        F.lit(None).cast("long").alias("item"), F.lit(None).cast("long").alias("item_id"), F.lit(None).cast("array<string>").alias("terms"), F.lit(None).cast("array<bigint>").alias("ids"),
    )
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = index.shards.select("shard", "ids", "lengths", every.alias("block")).select(group.alias("key"), F.lit(0).alias("kind"), "ids", F.col("lengths").alias("docs"))
    # each shard is told of all items: both sides are dealt out by the items' shares
    shares = F.explode(F.sequence(F.lit(0), F.lit(p.shares - 1))).alias("share")
    asks = index.shards.select("shard", shares).join(asked.select("item", "item_id", "terms", block.alias("block"), F.pmod(F.xxhash64("item", F.lit(1)), F.lit(p.shares)).cast("int").alias("share")), "share")
    asks = asks.select(group.alias("key"), F.lit(2).alias("kind"), "item", "item_id", "terms")
    rows = lists.unionByName(dealt, allowMissingColumns=True).unionByName(asks, allowMissingColumns=True)

    def one(held: dict[str, list]) -> list[tuple]:
        kinds = held["kind"]
        if 0 not in kinds or 1 not in kinds:
            return []
        at = kinds.index(0)
        ids, own = held["ids"][at], Lists(np.asarray(held["docs"][at]), n, total, p)
        for i, kind in enumerate(kinds):
            if kind == 1:
                own.put(held["term"][i], held["w"][i], *(np.asarray(held[c][i]) for c in ("docs", "occurs", "most", "shortest")))
        out = []
        for i, kind in enumerate(kinds):
            if kind == 2:
                wanted, found = best_of(held["terms"][i], own, p.k)
                doc_ids = np.asarray(ids)[wanted]
                null = doc_ids == ABSENT
                best = np.lexsort((doc_ids, null, -found))[: p.k]
                out += [(held["item"][i], held["item_id"][i], None if null[b] else int(doc_ids[b]), int(found[b])) for b in best.tolist()]
        return out

    found = map_groups(rows, "key", schema, one)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    out = written(found.withColumn("rank", rank).filter(F.col("rank") <= p.k).select("item_id", "rank", "doc_id", "score"), "ranked")
    discard(hits)
    return out


def rank_documents(docs: DataFrame, items: DataFrame, p: Params = Params()) -> DataFrame:
    """search() in a new index of docs."""
    index = build(docs, p)
    out = search(index, items, p)
    discard(index.table)
    return out


def oracle(k: int = 50) -> str:
    """DuckDB SQL for the same rows."""
    words = f"list_filter(regexp_split_to_array(translate(text, '{UPPER}', '{LOWER}'), '{BETWEEN}'), lambda w: w <> '')"
    return f"""
    WITH d AS (SELECT doc_id, {words} AS ws FROM documents),
    t AS (SELECT doc_id, len(ws) AS n, w, count(*) AS tf FROM (SELECT doc_id, ws, unnest(ws) AS w FROM d) GROUP BY ALL),
    tot AS (SELECT count(*) AS n_docs, sum(len(ws))::BIGINT AS total FROM d WHERE len(ws) > 0),
    df AS (SELECT w, count(*) AS df FROM t GROUP BY w),
    q AS (SELECT DISTINCT item_id, unnest({words}) AS w FROM benchmark),
    s AS (
      SELECT q.item_id, t.doc_id,
        sum(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // total))))::BIGINT AS score
      FROM q JOIN t ON t.w = q.w JOIN df ON df.w = q.w CROSS JOIN tot GROUP BY ALL
    ),
    r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
    SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= {k}
    """
