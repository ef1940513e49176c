"""The edits between two texts: a shortest script of inserted and deleted characters, made readable.

Up to CELLS pairs of places the table of longest common subsequences is kept as bits, a number for each row; larger texts are cut
in two first. Long texts are compared by words, and by characters only in between.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

KEPT, DELETED, INSERTED = "equal", "delete", "insert"
WORD = re.compile(r"\w+|\W")
Ops = list[tuple[str, Sequence]]
CELLS = 1 << 24  # of a table of bits, 2 MB
NEAR = 256  # edits up to which the meeting of two frontiers is looked for, which is the shorter way where long texts hardly differ


def rows(a: Sequence, b: Sequence) -> Iterator[int]:
    """After each element of a, bits of b's places: 0 where the longest common subsequence up to there is one longer than before it."""
    places: dict = {}
    for j, y in enumerate(b):
        places[y] = places.get(y, 0) | 1 << j
    every = (1 << len(b)) - 1
    row = every
    for x in a:
        both = row & places.get(x, 0)
        row = ((row + both) | (row - both)) & every
        yield row


def traced(a: Sequence, b: Sequence) -> Ops:
    """A shortest script, read off the whole table from its end."""
    table = [0, *rows(a, b)]
    i, j, out = len(a), len(b), []
    while i and j:
        start = i, j
        while i and j and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
        if start[0] > i:
            out.append((KEPT, a[i : start[0]]))
        elif table[i] >> (j - 1) & 1:
            while j and table[i] >> (j - 1) & 1 and a[i - 1] != b[j - 1]:
                j -= 1
            out.append((INSERTED, b[j : start[1]]))
        else:
            i -= 1
            out.append((DELETED, a[i : start[0]]))
    out += [(DELETED, a[:i])] * bool(i) + [(INSERTED, b[:j])] * bool(j)
    return out[::-1]


def half(a: Sequence, b: Sequence) -> tuple[int, int]:
    """The middle of a, and a place of b that a shortest path has there."""

    def common(x: Sequence, y: Sequence) -> np.ndarray:
        row = deque(rows(x, y), maxlen=1).pop()
        bits = np.unpackbits(np.frombuffer(row.to_bytes(len(y) // 8 + 1, "little"), "uint8"), bitorder="little")[: len(y)]
        return np.concatenate([[0], np.cumsum(bits == 0)])

    x = len(a) // 2
    return x, int(np.argmax(common(a[:x], b) + common(a[x:][::-1], b[::-1])[::-1]))


def meeting(a: Sequence, b: Sequence) -> tuple[int, int] | None:
    """A point on a shortest path through the edit graph, at about half its length; None where that is over NEAR edits."""
    n, m = len(a), len(b)
    most, skew = min(NEAR, (n + m + 1) // 2), n - m
    ahead, back = [-1] * (2 * (n + m) + 5), [-1] * (2 * (n + m) + 5)  # by diagonal; negative ones from the end
    ahead[1] = back[1] = 0
    for d in range(most + 1):
        for reach, mine, from_end in ((ahead, back, False), (back, ahead, True)):
            for k in range(-d, d + 1, 2):
                if k < -m or k > n:
                    continue
                x = reach[k + 1] if k == -d or (k != d and reach[k - 1] < reach[k + 1]) else reach[k - 1] + 1
                y = x - k
                if x < 0 or y < 0 or x > n or y > m:
                    continue
                while x < n and y < m and (a[n - 1 - x] == b[m - 1 - y] if from_end else a[x] == b[y]):
                    x, y = x + 1, y + 1
                reach[k] = x
                other = mine[skew - k]
                if other >= 0 and abs(skew - k) <= (d if from_end else d - 1) and x + other >= n:
                    return (n - x, m - y) if from_end else (x, y)
    return None


def script(a: Sequence, b: Sequence) -> Ops:
    """A shortest script from a to b, not merged."""
    out, todo = [], [(a, b)]
    while todo:
        a, b = todo.pop()
        if isinstance(a, tuple) and a and a[0] is KEPT and b is None:
            out.append(a)
            continue
        size = min(len(a), len(b))
        start = next((k for k in range(size) if a[k] != b[k]), size)
        size -= start
        end = next((k for k in range(size) if a[len(a) - 1 - k] != b[len(b) - 1 - k]), size)
        if start:
            out.append((KEPT, a[:start]))
        tail = ((KEPT, a[len(a) - end :]), None) if end else None
        a, b = a[start : len(a) - end], b[start : len(b) - end]
        if tail:
            todo.append(tail)
        if a and b and (len(a) * len(b) <= CELLS or len(a) == 1):
            out += traced(a, b)
        elif a and b:
            point = meeting(a, b)
            x, y = point if point not in (None, (0, 0), (len(a), len(b))) else half(a, b)
            todo += [(a[x:], b[y:]), (a[:x], b[:y])]
        else:
            out += [(DELETED, a)] * bool(a) + [(INSERTED, b)] * bool(b)
    return out


def merged(ops: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Between two kept stretches one deletion and one insertion at most, in this order."""
    out: list[tuple[str, str]] = []
    gone = come = ""
    for kind, text in [*ops, (KEPT, "")]:
        if kind == DELETED:
            gone += text
        elif kind == INSERTED:
            come += text
        elif text or kind == KEPT and (gone or come):
            out += [(DELETED, gone)] * bool(gone) + [(INSERTED, come)] * bool(come)
            gone = come = ""
            if text and out and out[-1][0] == KEPT:
                out[-1] = KEPT, out[-1][1] + text
            elif text:
                out.append((KEPT, text))
    return out


def readable(ops: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Without kept stretches that are no longer than the edits on either side: such a chance match only tears a change apart."""
    ops = merged(ops)
    while True:
        out: list[tuple[str, str]] = []
        for k, (kind, text) in enumerate(ops):
            sides = [[len(t) for o, t in some if o != KEPT] for some in (ops[max(0, k - 2) : k], ops[k + 1 : k + 3])]
            torn = kind == KEPT and all(sides) and len(text) <= min(map(max, sides))
            out += [(DELETED, text), (INSERTED, text)] if torn else [(kind, text)]
        if len(out) == len(ops):
            return ops
        ops = merged(out)


def edits(a: str | None, b: str | None, most: int = 240) -> list[tuple[str, str]]:
    """(equal, delete or insert, text) from a to b. Texts of over `most` characters in all are compared by words first."""
    a, b = a or "", b or ""
    if len(a) + len(b) <= most:
        return readable([(k, "".join(t)) for k, t in script(a, b)])
    coarse = merged([(k, "".join(t)) for k, t in script(tuple(WORD.findall(a)), tuple(WORD.findall(b)))])
    out, gone = [], ""
    for kind, text in [*coarse, (KEPT, "")]:
        if kind == DELETED:
            gone = text
            continue
        if kind == INSERTED and gone and len(gone) + len(text) <= most:
            out += [(k, "".join(t)) for k, t in script(gone, text)]
        else:
            out += [(DELETED, gone)] * bool(gone) + [(kind, text)] * bool(text)
        gone = ""
    return readable(out)


def text_edits(before: Column, after: Column) -> Column:
    """edits() of two columns, as array<struct<op, text>>; null counts as empty."""

    @pandas_udf("array<struct<op: string, text: string>>")
    def each(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([[{"op": k, "text": t} for k, t in edits(x, y)] for x, y in zip(a, b, strict=True)])

    return each(before, after)
