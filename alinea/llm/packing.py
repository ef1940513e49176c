"""Best-fit packing of token pieces into sequences by linear grouping.

Only how many pieces there are of each length matters for a packing, and that is a list as long as a sequence, whatever the
input. The driver packs this list: long lengths, in falling order, fall into groups of equal cardinality and are rounded up to
the longest of their group; a linear programme over the few rounded sizes, with patterns made when a knapsack finds one that
pays, says how many sequences of each pattern there are; the actual lengths take the places of the rounded ones; and what is
left, the short ones above all, goes best fit into the room that remains. Sequences that hold the same lengths are one kind
with a count. The pieces themselves stay on the cluster: each is numbered among those of its length, and the number names its
sequence and place.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import APART, is_even
from .common import kept, map_rows, written

COLUMNS = "doc_id long, piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class Params:
    size: int = 1024  # tokens a sequence
    end: int = 2  # the id after each document
    small: tuple[int, ...] = (128, 256, 400, 450, 512)  # lengths up to it are placed best fit alone; the best of these is kept
    groups: int = 192
    rounds: int = 3000  # of the linear programme at most; each round's answer is a packing, the last the best


@dataclass
class Kind:
    """count sequences that hold the same lengths: (length, how many) in order."""

    parts: list[tuple[int, int]]
    count: int
    room: int


def grouped(counts: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """Lengths in falling order as groups of (length, count), of equal cardinality; where they are few, each is a group and none is rounded."""
    if len(counts) <= groups:
        return [[(length, counts[length])] for length in sorted(counts, reverse=True)]
    total, out, seen = sum(counts.values()), [], 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            g = seen * groups // total
            some = min(left, -(-(g + 1) * total // groups) - seen)  # up to the group's end
            if out and (out[-1][0] == g or out[-1][1][0][0] == length):  # groups of one rounded size become one
                out[-1] = (g, [*out[-1][1], (length, some)])
            else:
                out.append((g, [(length, some)]))
            seen, left = seen + some, left - some
    return [parts for _, parts in out]


def best_pattern(sizes: np.ndarray, worth: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The unbounded knapsack: how many of each size together are worth most. One more piece at each turn, for all rooms at once."""
    at = np.arange(room + 1)[:, None] - sizes[None, :]
    fits, value, turns = at >= 0, np.zeros(room + 1), []
    at = np.maximum(at, 0)
    for _ in range(room // int(sizes.min())):
        each = np.where(fits, value[at] + worth, 0.0)
        took = each.argmax(1)
        new = each[np.arange(room + 1), took]
        better = new > value + 1e-12
        if not better.any():
            break
        turns.append(np.where(better, took, -1))
        value = np.where(better, new, value)
    out, c = np.zeros(len(sizes), int), room
    for took in reversed(turns):
        if took[c] >= 0:
            out[took[c]] += 1
            c -= sizes[took[c]]
    return float(value[room]), out


def configurations(sizes: np.ndarray, demand: np.ndarray, p: Params) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often each, fractions too, so that the demand is met with the fewest sequences."""
    basis = np.diag(p.size // sizes).astype(float)
    often = demand / np.diag(basis)
    for _ in range(p.rounds):
        worth = np.linalg.solve(basis.T, np.ones(len(sizes)))
        value, pattern = best_pattern(sizes, np.maximum(worth, 0), p.size)
        if value <= 1 + 1e-9:
            break
        into = np.linalg.solve(basis, pattern.astype(float))
        steps = np.where(into > 1e-9, np.maximum(often, 0) / np.where(into > 1e-9, into, 1), np.inf)
        out = int(steps.argmin())
        if not np.isfinite(steps[out]):
            break
        often = often - steps[out] * into
        often[out], basis[:, out] = steps[out], pattern
    return [(basis[:, k].astype(int), max(0.0, float(often[k]))) for k in range(len(sizes))]


def substituted(groups: list[list[tuple[int, int]]], plans: list[tuple[np.ndarray, int]], p: Params) -> tuple[list[Kind], dict[int, int]]:
    """Actual lengths in the places of the rounded ones, longest first, and the lengths for which no place was left."""
    queues = [[*reversed(g)] for g in groups]
    kinds = []
    for pattern, count in plans:
        slots, cuts = [], {0, count}
        for g in np.repeat(np.arange(len(groups)), pattern).tolist():
            at, slot = 0, []
            while at < count and queues[g]:
                length, some = queues[g].pop()
                if some > count - at:
                    queues[g].append((length, some - (count - at)))
                    some = count - at
                slot.append((at, length))
                at += some
            if at < count:
                slot.append((at, 0))  # the group has run out
            slots.append(slot)
            cuts.update(a for a, _ in slot)
        edges = sorted(cuts)
        for a, b in zip(edges, edges[1:], strict=False):
            held = defaultdict(int)
            for slot in slots:
                held[[length for at, length in slot if at <= a][-1]] += 1
            held.pop(0, None)
            parts = sorted(held.items(), reverse=True)
            kinds.append(Kind(parts, b - a, p.size - sum(length * n for length, n in parts)))
    left = defaultdict(int)
    for queue in queues:
        for length, some in queue:
            left[length] += some
    return kinds, left


def best_fit(kinds: list[Kind], rest: dict[int, int], p: Params) -> list[Kind]:
    """The rest in falling order, each piece to the sequence with the least room that suffices, as many kinds at once as there are."""
    by_room: list[list[Kind]] = [[] for _ in range(p.size + 1)]
    for kind in kinds:
        by_room[kind.room].append(kind)
    for length in sorted(rest, reverse=True):
        left = rest[length]
        room = length
        while left:
            while room < p.size and not by_room[room]:
                room += 1
            if by_room[room]:
                kind = by_room[room].pop()
            else:
                kind = Kind([], left, p.size)
            each = min(left, room // length)
            full = min(kind.count, left // each)
            by_room[room - each * length].append(Kind([*kind.parts, (length, each)], full, room - each * length))
            left -= full * each
            if kind.parts and kind.count > full:
                by_room[room].append(Kind(kind.parts, kind.count - full, room))
    return [kind for some in by_room for kind in some]


def by_groups(counts: dict[int, int], small: int, p: Params) -> list[Kind]:
    """The scheme with one bound of what is small."""
    large = {n: c for n, c in counts.items() if n > small}
    rest = defaultdict(int, {n: c for n, c in counts.items() if n <= small})
    kinds = []
    if large:
        groups = grouped(large, p.groups)
        sizes, demand = np.array([g[0][0] for g in groups]), np.array([sum(c for _, c in g) for g in groups], float)
        plans = [(pattern, int(often + 1e-9)) for pattern, often in configurations(sizes, demand, p)]
        kinds, left = substituted(groups, [x for x in plans if x[1]], p)
        for n, c in left.items():
            rest[n] += c
    return best_fit(kinds, rest, p)


def sequences(kinds: list[Kind]) -> int:
    return sum(kind.count for kind in kinds)


def packed(counts: dict[int, int], p: Params = Params()) -> list[Kind]:
    """counts: pieces of each length, 1 to p.size. Kinds of sequences that hold each piece once, as few sequences as any bound in p.small gives.

    The higher the bound, the less is lost by rounding and the more is left to best fit; at half a sequence the long ones lie alone.
    """
    whole = counts.get(p.size, 0)
    own = {n: c for n, c in counts.items() if n < p.size and c}
    kinds = min((by_groups(own, small, p) for small in p.small), key=sequences)  # the first of equals
    return kinds + ([Kind([(p.size, 1)], whole, 0)] if whole else [])


RUNS = ["length", "first", "count", "each", "sequence", "offset"]


def runs(kinds: list[Kind]) -> pd.DataFrame:
    """Where the pieces numbered from `first` on of a length go: to `count` sequences, `each` in a row, from `offset` on.

    There are a few for each kind, and kinds are bounded by the lengths and groups, not by the pieces.
    """
    rows, next_of, sequence = [], defaultdict(int), 0
    for kind in kinds:
        offset = 0
        for length, each in kind.parts:
            rows.append((length, next_of[length], kind.count, each, sequence, offset))
            next_of[length] += kind.count * each
            offset += length * each
        sequence += kind.count
    return pd.DataFrame(rows, columns=RUNS).sort_values(["length", "first"], ignore_index=True)


def tokenizer(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True  # their strings in a text are ordinary text
    return found


class Encoder:
    """Ids of texts by a tokenizer of byte-level pre-tokens, with the ids of words already met.

    Between two signs that are no white space, a blank begins a pre-token and a line end is one, so that what lies between is
    encoded alone, however often and wherever it comes. A new word is encoded once, many in one text, a word a line, and the
    ids are kept, until all that is kept takes `most` ids. A word's key is the word if a blank is before it, else begins with
    a line end.
    """

    def __init__(self, path: str, most: int = 12_000_000, batch: int = 1 << 18) -> None:
        self.tokenizer, self.most, self.batch = tokenizer(path), most, batch
        ends = self.tokenizer.encode("a\n b\nc", add_special_tokens=False).ids
        parts = [self.tokenizer.encode(t, add_special_tokens=False).ids for t in ("a", "\n", " b", "c")]
        self.line = parts[1][0] if ends == [*parts[0], *parts[1], *parts[2], *parts[1], *parts[3]] and len(parts[1]) == 1 else None
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}  # of a word among those that are kept
        self.flat, self.ends = np.array([], "<u4"), np.zeros(1, "int64")

    def _keep(self, keys: list[str], flat: list[np.ndarray], sizes: list[int] | np.ndarray) -> None:
        self.place.update(zip(keys, range(len(self.place), len(self.place) + len(keys)), strict=True))
        self.flat = np.concatenate([self.flat, *flat])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes, dtype="int64")])

    def _learn(self, keys: list[str], plain: bool) -> None:
        """plain: no word holds white space. So many characters at a time, as encodings take far more memory than ids."""
        at = 0
        while at < len(keys):
            to, n = at, 0
            while to < len(keys) and (to == at or n + len(keys[to]) <= self.batch):
                n += len(keys[to]) + 1
                to += 1
            some = keys[at:to]
            if plain and self.line is not None:
                text = "\n ".join(some).replace("\n \n", "\n")
                text = text[1:] if text[0] == "\n" else " " + text
                ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
                cuts = np.flatnonzero(ids == self.line)
                self._keep(some, [ids[ids != self.line]], np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1)
            else:
                found = [np.array(f.ids, "<u4") for f in self.tokenizer.encode_batch_fast([k[1:] if k[0] == "\n" else " " + k for k in some], add_special_tokens=False)]
                self._keep(some, found, [len(f) for f in found])
            at = to

    def _places(self, keys: pa.Array, plain: bool) -> np.ndarray:
        coded = keys.dictionary_encode()
        own = coded.dictionary.to_numpy(zero_copy_only=False)
        at = np.array(list(map(self.place.get, own)), dtype=object)
        lacking = np.flatnonzero(np.equal(at, None))
        new = own[lacking].tolist()
        if new and plain:  # what stands for a line end, or for an empty line, is not plain
            self._learn([k for k in new if k in ("\n", "\n\n")], False)
            self._learn([k for k in new if k not in ("\n", "\n\n")], True)
        else:
            self._learn(new, False)
        at[lacking] = list(map(self.place.__getitem__, new))
        return at.astype("int64")[coded.indices.to_numpy()]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.flat) > self.most or len(self.place) > self.most // 8:
            self._forget()
        even = [is_even(t) and "\n\n" not in t for t in texts]
        # keys of even texts: a blank between any two, a line end and the word after it as two
        lists = pc.split_pattern(pa.array(["\n" + t.replace("\n", " \n\n \n") for t, e in zip(texts, even, strict=True) if e], pa.large_string()), " ")
        odd = []
        for text in (t for t, e in zip(texts, even, strict=True) if not e):
            first, *rest = APART.split(text)
            odd.append(["\n" + first, *rest])
        at = np.concatenate([self._places(pc.list_flatten(lists), True), self._places(pa.array([k for keys in odd for k in keys], pa.large_string()), False)])
        sizes = np.concatenate([pc.list_value_length(lists).to_numpy(), np.array([len(keys) for keys in odd], "int64")]).astype("int64")
        lengths = self.ends[at + 1] - self.ends[at]
        stops = np.cumsum(lengths)
        flat = self.flat[np.repeat(self.ends[at] - (stops - lengths), lengths) + np.arange(int(stops[-1]) if len(stops) else 0)]
        out = np.split(flat, np.concatenate([[0], stops])[np.cumsum(sizes)][:-1]) if len(texts) else []
        places = np.argsort(np.argsort(~np.array(even, bool), kind="stable"), kind="stable")
        return [out[k] for k in places.tolist()]


def pieces_of(docs: DataFrame, p: Params = Params(), path: str | None = None) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, and its number among those of its length in its task."""

    def fn():
        def make():
            return Encoder(path or public_tokenizers.path("byte_bpe_50k.json"))

        encoder, task, seen = kept(("encoder", path), make), TaskContext.get().partitionId(), defaultdict(int)

        def each(batch: pd.DataFrame) -> pd.DataFrame:
            rows = []
            for doc_id, ids in zip(batch["doc_id"].astype("Int64").tolist(), encoder.encode([t or "" for t in batch["text"]]), strict=True):
                ids = np.append(ids, np.uint32(p.end)).astype("<u4")
                first = len(ids) % p.size or p.size
                start = 0
                for piece, stop in enumerate(range(first, len(ids) + 1, p.size)):
                    n = stop - start
                    rows.append((None if doc_id is pd.NA else doc_id, piece, start, n, zlib.crc32(ids[start:stop].tobytes()), task, seen[n]))
                    seen[n] += 1
                    start = stop
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "task", "number"])
            return out.astype({"doc_id": "Int64"})

        return each

    return map_rows(docs.select("doc_id", "text"), f"{COLUMNS}, task int, number long", fn, keeps=True)


def pack(docs: DataFrame, p: Params = Params(), path: str | None = None) -> DataFrame:
    """One row for each piece of each row of docs: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document's ids and the end id after them are one piece, or, if they are more than a sequence holds, pieces as long as a
    sequence, the first shorter where they do not come out even. Null and empty texts are the end id alone. Rows that repeat an
    id are documents of their own; a null doc_id stays null. Sequences are numbered from 0 and filled without gaps. An empty
    table gives an empty one. Other columns are not read. Special tokens' strings in a text count as ordinary text.
    path: a tokenizer file that every executor can open.
    """
    pieces = written(pieces_of(docs, p, path), "pieces")
    ends = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    # each task's first number among the pieces of a length
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    bases = ends.select("task", "length", F.coalesce(before, F.lit(0)).alias("base"))
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # a row for each length
    told = docs.sparkSession.sparkContext.broadcast(runs(packed(counts, p)))

    def fn():
        table = {n: g.to_numpy() for n, g in told.value.groupby("length")}

        def each(batch: pd.DataFrame) -> pd.DataFrame:
            at = np.zeros((len(batch), 2), "int64")
            rank, length = batch["rank"].to_numpy(), batch["length"].to_numpy()
            for n in np.unique(length).tolist():
                here, own = length == n, table[n]
                run = own[np.searchsorted(own[:, 1], rank[here], side="right") - 1]
                off = rank[here] - run[:, 1]
                at[here, 0] = run[:, 4] + off % run[:, 2]
                at[here, 1] = run[:, 5] + off // run[:, 2] * n
            out = batch.drop(columns="rank").astype({"doc_id": "Int64"})
            out["sequence_id"], out["offset"] = at[:, 0], at[:, 1]
            return out

        return each

    ranked = pieces.join(bases, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("number")).alias("rank"))
    return map_rows(ranked, f"{COLUMNS}, sequence_id long, offset long", fn)
