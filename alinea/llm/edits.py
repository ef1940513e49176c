"""Edit-aware token counts: a segment tree over each document's pre-tokens, updated where an edit touches it.

A pre-token's match depends on the text from its start on, and on the few characters after its end that the pattern looks at.
So after an edit the pre-tokens that end well before it stay; matching starts again at the first that does not, and stops
where a match begins at an old start behind the edit: from there on all matches are as before. Only the pre-tokens between are
encoded again; the tree's sums are updated along their paths.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import codec_of
from .common import map_rows

LOOK = 4  # characters behind a pre-token that the pattern looks at, at most


@dataclass(frozen=True)
class Params:
    path: str | None = None  # vocabulary file; by default the public one of 50k tokens
    leaf: int = 64  # pre-tokens of a leaf, about


class CountTree:
    """Leaves of consecutive pre-tokens, each with its characters and tokens; inner nodes hold the sums of their children."""

    def __init__(self, text: str, codec, leaf: int) -> None:
        self.codec, self.leaf, self.encoded = codec, leaf, 0
        self.text = text
        self._fill(self._matched())

    def _matched(self):
        pairs = self.codec.counts(self.text)
        self.encoded += len(pairs)
        return pairs

    def _fill(self, pairs: list[tuple[int, int]]) -> None:
        self.leaves = [pairs[i : i + self.leaf] for i in range(0, len(pairs), self.leaf)] or [[]]
        self._build()

    def _build(self) -> None:
        """sums[1] is the root; the children of k are 2k and 2k + 1; leaves are at `base` and after."""
        self.base = 1
        while self.base < len(self.leaves):
            self.base *= 2
        self.sums = [(0, 0)] * (2 * self.base)
        for k, leaf in enumerate(self.leaves):
            self.sums[self.base + k] = tuple(map(sum, zip(*leaf))) if leaf else (0, 0)
        for k in range(self.base - 1, 0, -1):
            self.sums[k] = tuple(a + b for a, b in zip(self.sums[2 * k], self.sums[2 * k + 1]))

    def _update(self, leaf: int) -> None:
        k = self.base + leaf
        self.sums[k] = tuple(map(sum, zip(*self.leaves[leaf]))) if self.leaves[leaf] else (0, 0)
        while k > 1:
            k //= 2
            self.sums[k] = tuple(a + b for a, b in zip(self.sums[2 * k], self.sums[2 * k + 1]))

    @property
    def tokens(self) -> int:
        return self.sums[1][1]

    def find(self, at: int) -> tuple[int, int, int]:
        """The leaf and place of the pre-token that holds the character `at` (the last if there is none), and its start."""
        k, start = 1, 0
        at = min(at, self.sums[1][0] - 1)
        while k < self.base:
            k *= 2
            if at - start >= self.sums[k][0]:
                start += self.sums[k][0]
                k += 1
        leaf, place = k - self.base, 0
        own = self.leaves[leaf] if leaf < len(self.leaves) else []
        while place < len(own) - 1 and start + own[place][0] <= at:
            start += own[place][0]
            place += 1
        return leaf, place, start

    def edit(self, start: int, removed: int, inserted: str) -> None:
        """Replaces text[start : start + removed]."""
        old = self.text
        start = max(0, min(start, len(old)))
        stop = min(len(old), start + max(0, removed))
        self.text = old[:start] + inserted + old[stop:]
        if not self.sums[1][0]:
            self._fill(self._matched())
            return
        leaf, place, at = self.find(max(0, start - LOOK))
        first = leaf, place
        shift = len(inserted) - (stop - start)
        leaf_, place_, old_at = leaf, place, at  # walks over the old pre-tokens
        fresh: list[tuple[int, int]] = []
        matches = self.codec.pattern.finditer(self.text, at)
        new_at = at
        while True:
            if new_at >= start + len(inserted):
                while leaf_ < len(self.leaves) and old_at + shift < new_at:
                    old_at += self.leaves[leaf_][place_][0]
                    place_ += 1
                    if place_ == len(self.leaves[leaf_]):
                        leaf_, place_ = leaf_ + 1, 0
                        while leaf_ < len(self.leaves) and not self.leaves[leaf_]:
                            leaf_ += 1
                if old_at >= stop and old_at + shift == new_at and leaf_ < len(self.leaves):
                    break
            m = next(matches, None)
            if m is None:
                leaf_, place_ = len(self.leaves), 0
                break
            self.encoded += 1
            fresh.append((m.end() - m.start(), len(self.codec.pieces[m[0]]) // 4))
            new_at = m.end()
        if leaf_ == first[0]:
            self.leaves[leaf_][first[1] : place_] = fresh
            touched = [leaf_]
        else:
            rest = self.leaves[leaf_][place_:] if leaf_ < len(self.leaves) else []
            self.leaves[first[0]][first[1] :] = fresh + rest
            touched = range(first[0], min(leaf_ + 1, len(self.leaves)))
            for k in touched[1:]:
                self.leaves[k] = []
        if len(self.leaves[first[0]]) > 4 * self.leaf:  # a leaf that grew is cut up
            self._fill([pair for leaf in self.leaves for pair in leaf])
        else:
            for k in touched:
                self._update(k)


def count_edits(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """docs: doc_id, text, edits (array of struct<start, removed, inserted>, in the order in which they are made).

    One row per row of docs: doc_id, n_tokens (of the text), n_tokens_edited, n_chars_edited, n_pretokens (of the text) and
    n_encoded_again. Positions count code points of the text that the edits before have left; a start beyond the end appends,
    a removal ends with the text. Null texts, edits and inserted texts count as empty. Null doc_ids stay.
    """

    def fn():
        codec = codec_of(p.path or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)

        def one(text: str | None, edits):
            tree = CountTree(text or "", codec, p.leaf)
            n, whole = tree.tokens, tree.encoded
            for e in edits if edits is not None else []:
                if e is not None:
                    tree.edit(e["start"] or 0, e["removed"] or 0, e["inserted"] or "")
            return n, tree.tokens, len(tree.text), whole, tree.encoded - whole

        def each(batch: pd.DataFrame) -> pd.DataFrame:
            out = pd.DataFrame([one(t, e) for t, e in zip(batch["text"], batch["edits"], strict=True)], columns=["n_tokens", "n_tokens_edited", "n_chars_edited", "n_pretokens", "n_encoded_again"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy(dtype=object))
            return out

        return each

    schema = "doc_id long, n_tokens long, n_tokens_edited long, n_chars_edited long, n_pretokens long, n_encoded_again long"
    return map_rows(docs.select("doc_id", "text", "edits"), schema, fn, keeps=True)


def sample_edits(docs: DataFrame) -> DataFrame:
    """The edits of the registered query, for every document: seven characters go, a line comes in, a note is appended."""
    n = F.coalesce(F.length("text"), F.lit(0))
    note = F.concat(F.lit("\nNote "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(": it's done."))
    edit = lambda start, removed, inserted: F.struct(start.cast("int").alias("start"), F.lit(removed).alias("removed"), inserted.alias("inserted"))
    edits = F.array(edit(F.floor(n / 2), 7, F.lit("")), edit(F.floor(n / 3), 0, F.lit(" new line\n\n 12ab")), edit(n + 1000, 0, note))
    return docs.select("doc_id", "text", edits.alias("edits"))
