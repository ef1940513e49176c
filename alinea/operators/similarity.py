"""Matching texts and vectors against a library.

Text similarity is the cosine of term frequencies. Queries and library are dealt out by hash and meet block by block; the library
is told to all tasks only when its size was checked.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alinea.config import DEFAULT, Config
from alinea.functions.text import library_key
from alinea.operators.blocks import Near, in_blocks

CELLS = 1 << 21  # of a matrix of queries and items that is worked on at once


class TextBlock:
    """Library texts of one block by their terms, and how near queries are to them: the cosine of term frequencies."""

    def __init__(self, items: np.ndarray, texts: list[str]) -> None:
        self.items = items
        self.row, term, self.n, self.terms, self.norm = term_counts(texts)
        order = np.argsort(term, kind="stable")
        self.row, self.n = self.row[order], self.n[order]
        self.ends = np.searchsorted(term[order], np.arange(len(self.terms)), "right")
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(int)
        self.exact: dict[str, list] = {}
        for text, item in sorted(zip(texts, items.tolist(), strict=True)):
            if text:
                self.exact.setdefault(text, []).append(item)

    def near(self, texts: list[str], least: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions of texts, items and similarities of over `least`: of each text the best k, by item where they tie."""
        row, term, n, terms, norm = term_counts(texts)
        known = pd.Index(self.terms).get_indexer(terms)[term] if len(self.terms) else np.full(len(term), -1)
        row, term, n = row[known >= 0], known[known >= 0], n[known >= 0]
        out, width, size = [], max(1, len(self.items)), max(1, CELLS // max(1, len(self.items)))
        for at in range(0, len(texts), size):
            lo, hi = np.searchsorted(row, [at, at + size])
            height = min(size, len(texts) - at)
            shared = np.zeros(height * width)
            lengths = self.ends[term[lo:hi]] - self.starts[term[lo:hi]]
            cuts = [*np.searchsorted(np.cumsum(lengths), np.arange(0, lengths.sum(), CELLS)), hi - lo]
            for a, b in zip(cuts, cuts[1:], strict=False):  # so many shared terms at once
                r, t, m, each = row[lo + a : lo + b], term[lo + a : lo + b], n[lo + a : lo + b], lengths[a:b]
                place = np.arange(each.sum()) + np.repeat(self.starts[t] - np.cumsum(each) + each, each)
                shared += np.bincount(np.repeat(r - at, each) * width + self.row[place], np.repeat(m, each) * self.n[place], height * width)
            cells = np.flatnonzero(shared)
            q, item = cells // width + at, cells % width
            s = shared[cells] / (norm[q] * self.norm[item])
            q, item, s = q[s > least], self.items[item[s > least]], s[s > least]
            order = np.lexsort((item, -np.round(s, 9), q))
            q, item, s = q[order], item[order], s[order]
            best = np.arange(len(q)) - np.searchsorted(q, q) < k
            out.append((q[best], item[best], s[best]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int), self.items[:0], np.zeros(0))


def term_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """row, term, n of each term of each text in order of rows; the terms that are meant; the length of each text as a vector."""
    words = [[w for w in t.split(" ") if w] for t in texts]
    term, terms = pd.factorize(np.array([w for x in words for w in x], object))
    row = np.repeat(np.arange(len(words)), [len(x) for x in words])
    cells, n = np.unique(row * max(1, len(terms)) + term, return_counts=True)
    row, term = cells // max(1, len(terms)), cells % max(1, len(terms))
    return row, term, n, terms, np.sqrt(np.bincount(row, n * n, len(words)))


def exact_matches(queries: DataFrame, library: DataFrame, query: str, item: str, text: str = "text") -> DataFrame:
    """query, item, similarity 1.0 where the normalised texts are equal and not empty."""
    a = queries.select(query, library_key(F.col(text)).alias("k")).filter("k <> ''")
    b = library.select(item, library_key(F.col(text)).alias("k")).filter("k <> ''")
    return a.join(b, "k").select(query, item, F.lit(1.0).alias("similarity")).distinct()


def matched_texts(queries: DataFrame, library: DataFrame, query: str, item: str, k: int = 2, cfg: Config = DEFAULT, least: int = 8, block: int = 16_384) -> DataFrame:
    """query, item, similarity, rank: exact matches; for queries without one, the k most similar within the library distance.

    Texts are compared as keys; empty ones match nothing, and those of under `least` characters exactly only. query and item are
    unique numbers. Ties go to the smaller item.
    """
    floor = 1 - cfg.library_distance

    def prepare(held: pd.DataFrame) -> Near:
        texts = TextBlock(held["id"].to_numpy(), held["text"].tolist())

        def near(asked: pd.DataFrame) -> pd.DataFrame:
            equal = [(q, i, 1.0, True) for q, t in zip(asked["id"], asked["text"], strict=True) for i in texts.exact.get(t, [])[:k]]
            rest = asked[[len(t) >= least and t not in texts.exact for t in asked["text"]]]
            place, found, s = texts.near(rest["text"].tolist(), floor, k)
            alike = pd.DataFrame({"q": rest["id"].to_numpy()[place], "item": found, "similarity": s, "equal": False})
            return pd.concat([pd.DataFrame(equal, columns=alike.columns), alike]) if equal else alike

        return near

    keyed = lambda df, name: df.select(F.col(name).cast("long").alias("id"), F.coalesce(library_key(F.col("text")), F.lit("")).alias("text"))
    hits = in_blocks(keyed(queries, query), keyed(library, item), prepare, "q long, item long, similarity double, equal boolean", block)
    hits = hits.withColumn("_any", F.max("equal").over(Window.partitionBy("q"))).filter(F.col("equal") == F.col("_any"))
    ranked = Window.partitionBy("q").orderBy(F.desc(F.round("similarity", 9)), "item")
    hits = hits.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
    return hits.select(F.col("q").alias(query), F.col("item").alias(item), "similarity", "rank")


def boosted(similarity: Column, same_category: Column, same_section: Column) -> Column:
    """A tenth more in the category that was hinted at, 15 % more in the same section; each at most 1."""
    s = F.when(same_category, F.least(F.lit(1.0), similarity * 1.1)).otherwise(similarity)
    return F.when(same_section, F.least(F.lit(1.0), s * 1.15)).otherwise(s)


def retrieved(hits: DataFrame, group: str, query: str, item: str, cfg: Config = DEFAULT) -> DataFrame:
    """hits: group, query, item, similarity. The best of each query, each item once with its best, then the best of the group."""
    near = hits.filter(1 - F.col("similarity") < cfg.retrieval_distance)
    w = Window.partitionBy(group, query).orderBy(F.desc(F.round("similarity", 9)), item)
    near = near.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= cfg.retrieval_per_query)
    once = near.groupBy(group, item).agg(F.max("similarity").alias("similarity"))
    w = Window.partitionBy(group).orderBy(F.desc(F.round("similarity", 9)), item)
    return once.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= cfg.retrieval_final)
