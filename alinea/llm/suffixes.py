"""Suffix-array dedup: which bytes lie in a string of `length` bytes that also starts anywhere else.

The suffix array is built without recursion or renaming. Suffixes are put into groups by their Lyndon prefix: groups are taken
in descending order; each member's previous smaller suffix, found by following such pointers, has the group's prefix behind
its own, and moves to a group of its own just after the one that it leaves, those with more repeats last. Then the order
inside the groups is read off from the left: a placed suffix places those whose Lyndon prefix ends where it begins.

On a corpus, strings that could be equal first meet by their anchor (anchors.py). A stretch of strings whose whole content
occurs twice is repeated as it is; a suffix array is built only of the differing stretches of one anchor. They are aligned at
it, so columns between which no two of them begin or cease to agree are one symbol of that array; its longest common prefixes
with the neighbours say how far each start is repeated.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import stretches
from .common import discard, map_groups, map_rows, written


@dataclass(frozen=True)
class Params:
    length: int = 400
    gram: int = 64
    most: int = 512  # differing stretches of one anchor in one suffix array; more are dealt out by longer anchors first

    def grams(self) -> list[int]:
        """Lengths of anchors, one level after the other; on the last a string is its own anchor, and nothing differs."""
        return [self.gram, self.length // 2, 4 * self.length // 5, self.length]


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes in ascending order; a suffix precedes those that it begins."""
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    place, group, end = [0] * n, [0] * n, {}
    start = 0
    for k, i in enumerate(order):
        if text[i] != text[order[start]]:
            start = k
        place[i], group[i], end[start] = k, start, k + 1
    before = [-1] * n
    high = n
    while high:
        start = group[order[high - 1]]
        repeats: dict[int, int] = defaultdict(int)
        for i in sorted(order[start:high]):
            p = i - 1
            while p >= 0 and group[p] >= start:
                p = before[p]
            before[i] = p
            if p >= 0:
                repeats[p] += 1
        by_count: dict[int, list[int]] = defaultdict(list)
        for p, times in repeats.items():
            by_count[times].append(p)
        for times in sorted(by_count, reverse=True):
            leaving: dict[int, list[int]] = defaultdict(list)
            for p in by_count[times]:
                leaving[group[p]].append(p)
            for old, some in leaving.items():
                last = stop = end[old]
                for p in some:
                    last -= 1
                    q, at = order[last], place[p]
                    order[at], order[last], place[q], place[p] = q, p, at, last
                end[old] = last
                for p in some:
                    group[p] = last
                end[last] = stop
        high = start
    out, free = [0] * n, {g: g for g in set(group)}

    def put(i: int, until: int) -> None:
        while i != until:
            out[free[group[i]]] = i
            free[group[i]] += 1
            i = before[i]

    put(n - 1, -1)
    for k in range(n):
        j = out[k]
        put(j - 1, before[j])
    return out


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def repeated_starts(contents: list[bytes], offsets: list[int], starts: list[int], length: int) -> list[list[tuple[int, int]]]:
    """For each of the differing contents of one anchor: the runs (first, last) of its starts whose string another one has too.

    offsets: the anchor's place in each content; starts: how many strings it has (they begin at 0, 1, ...).
    """
    rights = [c[o:] for c, o in zip(contents, offsets, strict=True)]
    lefts = [c[:o][::-1] for c, o in zip(contents, offsets, strict=True)]
    cuts = []
    for parts in (lefts, rights):
        ordered = sorted(parts)
        cuts.append(sorted({0, *(common(a, b) for a, b in zip(ordered, ordered[1:], strict=False))}))
    text: list[int] = []
    numbers: dict[tuple[int, bytes], int] = {}
    marks = []  # (content, distance of the symbol's start left of the anchor, of its end; bytes) of each symbol
    for k, content in enumerate(contents):
        o = offsets[k]
        edges = [o - c for c in reversed(cuts[0]) if c < o] + [o + c for c in cuts[1] if 0 < c < len(rights[k])]
        edges = [0, *(e for e in edges if e > 0), len(content)]
        for a, b in zip(edges, edges[1:], strict=False):
            text.append(len(contents) + numbers.setdefault((o - a, content[a:b]), len(numbers)))
            marks.append((k, o - a, o - b, b - a))
        text.append(k)  # an end of its own
        marks.append((k, 0, 0, 0))
    order = suffix_array(text)
    rank = [0] * len(order)
    for r, i in enumerate(order):
        rank[i] = r
    shared, same, size = [0] * len(text), 0, [0]
    for m in marks:
        size.append(size[-1] + m[3])
    best = [0] * len(text)  # bytes shared with a neighbour
    for i in range(len(text)):  # longest common prefixes by the order of the text
        if rank[i]:
            j = order[rank[i] - 1]
            while text[i + same] == text[j + same]:
                same += 1
            shared[rank[i]] = same
            same = max(0, same - 1)
        else:
            same = 0
    for r, i in enumerate(order):
        most = max(shared[r], shared[r + 1] if r + 1 < len(order) else 0)
        best[i] = size[i + most] - size[i]
    out: list[list[tuple[int, int]]] = [[] for _ in contents]
    for i, (k, far, near, n) in enumerate(marks):
        if n and best[i] >= n and far >= 0:
            right = best[i] - far  # what the best partner shares from the anchor on
            low, high = max(near + 1 if far else 0, length - right, 0), far
            a, b = max(offsets[k] - high, 0), min(offsets[k] - low, starts[k] - 1)
            if low <= high and a <= b:
                out[k].append((a, b))
    return out


def find_stretches(docs: DataFrame, p: Params, level: int) -> DataFrame:
    """docs: u1, u2 (a row's identity), data. u1, u2, key, c1, c2, first, last, off for each stretch."""
    gram = p.grams()[level]

    def each(batch: pd.DataFrame) -> pd.DataFrame:
        rows, u1, u2 = [], [], []
        for a, b, data in zip(batch["u1"], batch["u2"], batch["data"], strict=True):
            found = stretches(data, p.length, gram)
            rows.append(found)
            u1.append(np.full(len(found), a))
            u2.append(np.full(len(found), b))
        table = np.concatenate(rows).astype("int64")
        return pd.DataFrame({"u1": np.concatenate(u1), "u2": np.concatenate(u2), "key": table[:, 0], "c1": table[:, 1], "c2": table[:, 2], "first": table[:, 3].astype("int32"), "last": table[:, 4].astype("int32"), "off": table[:, 5].astype("int32")})

    return map_rows(docs.filter(F.octet_length("data") >= p.length).select("u1", "u2", "data"), "u1 long, u2 long, key long, c1 long, c2 long, first int, last int, off int", lambda: each)


def contents_of(docs: DataFrame, wanted: DataFrame, p: Params) -> DataFrame:
    """wanted: u1, u2, key, c1, c2, first, last, off, size. key, c1, c2, off, starts, size, content."""
    lists = wanted.groupBy("u1", "u2").agg(F.collect_list(F.struct("key", "c1", "c2", "first", "last", "off", "size")).alias("at"))
    rows = docs.select("u1", "u2", "data").dropDuplicates(["u1", "u2"]).join(lists, ["u1", "u2"]).select("data", "at")

    def each(batch: pd.DataFrame) -> pd.DataFrame:
        out = []
        for data, at in zip(batch["data"], batch["at"], strict=True):
            out += [(r["key"], r["c1"], r["c2"], r["off"], r["last"] - r["first"] + 1, r["size"], data[r["first"] : r["last"] + p.length]) for r in at]
        return pd.DataFrame(out, columns=["key", "c1", "c2", "off", "starts", "size", "content"])

    return map_rows(rows, "key long, c1 long, c2 long, off int, starts int, size int, content binary", lambda: each)


def repeated_parts(docs: DataFrame, p: Params, level: int = 0) -> DataFrame:
    """docs: u1, u2, data; rows of one identity are equal, and each counts. u1, u2, a, b: byte ranges that repeated strings cover."""
    found = written(find_stretches(docs, p, level), "stretches")
    contents = found.groupBy("key", "c1", "c2").agg(F.count("*").alias("n"), F.min(F.struct("u1", "u2", "first", "last", "off")).alias("one"))
    contents = written(contents, "contents")
    marks = contents.filter("n > 1").select("key", "c1", "c2", F.lit(0).alias("low"), F.lit(None).cast("int").alias("high"))
    done = [found, contents]
    if level < len(p.grams()) - 1:
        keys = contents.groupBy("key").agg(F.count("*").cast("int").alias("size")).filter("size > 1")
        wanted = written(contents.join(keys, "key").select("one.*", "key", "c1", "c2", "size"), "wanted")
        done.append(wanted)
        pieces = contents_of(docs, wanted.filter(F.col("size") <= p.most), p)

        def compared(rows: dict[str, list]) -> list[tuple]:
            runs = repeated_starts(rows["content"], rows["off"], rows["starts"], p.length)
            return [(key, c1, c2, a, b) for key, c1, c2, some in zip(rows["key"], rows["c1"], rows["c2"], runs, strict=True) for a, b in some]

        marks = marks.unionByName(map_groups(pieces, "key", "key long, c1 long, c2 long, low int, high int", compared))
        many = wanted.filter(F.col("size") > p.most)
        if many.limit(1).count():
            ids = {"u1": F.xxhash64(F.lit(1), "key", "c1", "c2"), "u2": F.xxhash64(F.lit(2), "key", "c1", "c2")}
            hot = written(contents_of(docs, many, p).select("key", "c1", "c2", F.col("content").alias("data")).withColumns(ids), "hot")
            inner = repeated_parts(hot.select("u1", "u2", "data"), p, level + 1)
            back = hot.select("u1", "u2", "key", "c1", "c2").join(inner, ["u1", "u2"])
            marks = marks.unionByName(back.select("key", "c1", "c2", F.col("a").alias("low"), (F.col("b") - p.length).alias("high")))
            done += [hot, inner]
    marks = written(marks, "marks")
    hits = found.select("key", "c1", "c2", "u1", "u2", "first", "last").join(marks, ["key", "c1", "c2"])
    out = written(hits.select("u1", "u2", (F.col("first") + F.col("low")).alias("a"), (F.coalesce(F.col("first") + F.col("high"), F.col("last")) + p.length).alias("b")).distinct(), "ranges")
    for old in [*done, marks]:
        discard(old)
    return out


def merged_ranges(ranges) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def dedup(docs: DataFrame, p: Params = Params(), texts: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (any byte is); with texts also kept (binary).

    Null texts count as empty; texts shorter than the length lose nothing. Rows that repeat are texts of their own, so both
    lose what they share; null doc_ids stay. What is left can begin or end inside a character, so it is bytes. Other columns
    of docs are not read.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).withColumns({"u1": F.xxhash64(F.lit(1), "doc_id", "text"), "u2": F.xxhash64(F.lit(2), "doc_id", "text")})
    ranges = repeated_parts(rows.select("u1", "u2", F.col("text").cast("binary").alias("data")), p)
    lists = ranges.groupBy("u1", "u2").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))

    def each(batch: pd.DataFrame) -> pd.DataFrame:
        out = []
        for text, found in zip(batch["text"], batch["ranges"], strict=True):
            data = text.encode("utf-8", "surrogatepass")
            spans = merged_ranges((r["a"], r["b"]) for r in found) if found is not None else []
            edges = [0, *(e for s in spans for e in s), len(data)]
            kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            out.append((len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), bool(spans)) + (kept,) * texts)
        frame = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"] + ["kept"] * texts)
        frame.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy(dtype=object))
        return frame

    joined = rows.join(lists, ["u1", "u2"], "left").select("doc_id", "text", "ranges")
    return map_rows(joined, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed boolean" + ", kept binary" * texts, lambda: each)
