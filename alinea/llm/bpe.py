"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decoding.

The state is the bytes since the end of the last token, as far as they begin a token. When no token goes on with the next
byte, the longest that has been passed is put out if it fits behind the token before it, which alone decides whether BPE
leaves a boundary there; else a shorter one. If none fits, no boundary lies at that place: the token before it is taken back
and a shorter one tried. A place is given up once at most, so the work is linear; places have one last token each, so what
is put out up to the end is the BPE of the whole.
States and transitions are made when first met, and dropped when there are too many.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import string
from itertools import chain, islice

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from .common import Memo, kept, map_rows

LONG_TEXT = 1 << 20  # from so many characters on, pre-tokens are taken a block at a time
BLOCK = 50_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merged(piece: bytes, ranks: dict[bytes, int], below: int = 1 << 40) -> list[bytes]:
    """BPE as defined: merge the adjacent pair of lowest rank, leftmost first, until none (of a rank `below`) is in the vocabulary."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
        if rank >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class State(dict):
    """The states after one byte more, None if no token goes on so; they are made when first asked for."""

    __slots__ = ("of", "bytes", "best")

    def __init__(self, of: Transducer, own: bytes, best: int) -> None:
        self.of, self.bytes, self.best = of, own, best  # best: the longest token that has been passed, -1 if none

    def __missing__(self, byte: int) -> State | None:
        v = self.bytes + bytes((byte,))
        self[byte] = to = State(self.of, v, self.of.ranks.get(v, self.best)) if v in self.of.starts else None
        self.of.states += to is not None
        return to


class Transducer:
    def __init__(self, ranks: dict[bytes, int], most_states: int = 60_000) -> None:
        self.ranks, self.most_states = ranks, most_states
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.size = {rank: len(token) for token, rank in ranks.items()}
        self.starts = {t[:k] for t in ranks for k in range(1, len(t) + 1)}
        self.longest = max(self.size.values(), default=1)
        self.splits = Memo(self._split, 1 << 40)
        self.shorter = Memo(lambda token: self._longest(self.bytes_of[token][:-1]), 1 << 40)
        self.fits = Memo(self._fit, 200_000)
        self._forget()

    def _forget(self) -> None:
        self.states, self.first = 0, State(self, b"", -1)

    def _longest(self, v: bytes) -> int:
        """The longest token that v begins with; -1 if there is none."""
        return next((self.ranks[v[:k]] for k in range(len(v), 0, -1) if v[:k] in self.ranks), -1)

    def _split(self, token: int) -> tuple[int, ...] | None:
        """The two tokens whose merge makes this one; () for a byte, None if no merges of rising ranks lead to it."""
        whole = self.bytes_of[token]
        if len(whole) == 1:
            return ()
        parts = tuple(self.ranks[t] for t in merged(whole, self.ranks, token))
        return parts if len(parts) == 2 and all(self.size[t] == 1 or t < token and self.splits[t] for t in parts) else None

    def _fit(self, pair: int) -> bool:
        """Whether the BPE of both tokens' bytes is these two: their merges are undone, the last one first, and none before it may join the sides."""
        a, b = pair >> 32, pair & 0xFFFFFFFF
        of, ranks, splits, limit = self.bytes_of, self.ranks, self.splits, 1 << 40
        if splits[a] is None or splits[b] is None:
            return merged(of[a] + of[b], ranks) == [of[a], of[b]]
        while ranks.get(of[a] + of[b], limit) >= limit:
            left, right = splits[a], splits[b]
            if left and (a > b or not right):
                limit, a = a, left[1]  # at equal ranks the merge further left comes first
            elif right:
                limit, b = b + 1, right[0]
            else:
                return True
        return False

    def encode(self, piece: bytes) -> list[int]:
        if self.states > self.most_states:
            self._forget()
        first, size, fits, longest = self.first, self.size, self.fits, self.longest
        out: list[int] = []
        given_up: set[int] = set()
        at, n, before = 0, len(piece), -1
        while at < n:
            state = first
            for byte in piece[at : at + longest]:
                to = state[byte]
                if to is None:
                    break
                state = to
            token = state.best
            while token < 0 or before >= 0 and not fits[before << 32 | token] or given_up and at + size[token] in given_up:
                if token >= 0:
                    token = self.shorter[token]
                elif out:
                    given_up.add(at)
                    token = out.pop()
                    at -= size[token]
                    before = out[-1] if out else -1
                else:
                    raise ValueError(f"the vocabulary lacks a byte of {piece!r}")
            out.append(token)
            at += size[token]
            before = token
        return out


class Utf8Stream:
    """Incremental UTF-8: the state is the open sequence, at most three bytes; feed() returns the characters that are complete."""

    def __init__(self) -> None:
        self.open = b""

    def feed(self, chunk: bytes) -> str:
        data = self.open + chunk
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte >= 0xC0:  # a first byte: how many should follow it?
                if back < (2 if byte < 0xE0 else 3 if byte < 0xF0 else 4):
                    cut = len(data) - back
                break
            if byte < 0x80:
                break
        self.open = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.open = self.open, b""
        return rest.decode("utf-8", "replace")


#: The public pattern and an equal one that tries frequent alternatives first: only the contractions begin like another
#: alternative (a run of other signs), and they stay before it.
EQUAL_PATTERN = {public_tokenizers.PATTERN: r" ?\p{L}+| ?\p{N}+|'(?:s|t|re|ve|m|ll|d)| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"}
#: A single space between two other signs: a pre-token of EQUAL_PATTERN always begins there.
APART = re.compile(r"(?<=\S) (?=\S)")
#: White space other than the blank and the line end.
RARE_SPACE = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def is_even(text: str) -> bool:
    """Every blank stands between two signs that are no white space, as far as a quick look can tell."""
    return not (text[:1].isspace() or text[-1:].isspace() or "  " in text or " \n" in text or "\n " in text or any(c in text for c in RARE_SPACE))


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


#: Signs of ASCII that are no letters, numbers or white space.
SIGNS = string.punctuation


class Codec:
    """Encoding and decoding of whole texts with one vocabulary and pre-token pattern."""

    def __init__(self, path: str, pattern: str, most_pieces: int = 20_000, most_words: int = 150_000, longest: int = 64) -> None:
        """Kept are at most twice most_pieces pre-tokens and twice most_words words (four times, of counts), none of over `longest` characters."""
        ranks = load_ranks(path)
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.by_space = pattern in EQUAL_PATTERN
        self.pattern = regex.compile(EQUAL_PATTERN.get(pattern, pattern))
        self.transducer = Transducer(ranks)
        same: dict[tuple, tuple] = {}  # counts of short words are few, so their number is bounded: equal ones are one object
        self.pieces = Memo(lambda p: packed(self._ids(p)), most_pieces, longest)
        self.words = Memo(self._word, most_words, longest)
        self.word_counts = Memo(lambda w: same.setdefault(c := self._word_counts(w), c), 2 * most_words, longest)

    def _ids(self, piece: str) -> list[int]:
        return self.transducer.encode(piece.encode("utf-8", "surrogatepass"))

    def _pieces(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))

    def _counts(self, text: str) -> tuple[tuple[int, int], ...]:
        return tuple((len(m), len(self.pieces[m]) // 4) for m in self.pattern.findall(text))

    def _word(self, word: str) -> bytes:
        """The ids of a blank and the word. Letters, or letters and other signs of ASCII behind them, are pre-tokens by EQUAL_PATTERN."""
        letters = word.rstrip(SIGNS)
        if not letters.isalpha():
            return self._pieces(" " + word)
        ids = packed(self._ids(" " + letters))
        return ids if letters == word else ids + self.pieces[word[len(letters) :]]

    def _word_counts(self, word: str) -> tuple[tuple[int, int], ...]:
        letters = word.rstrip(SIGNS)
        if not letters.isalpha():
            return self._counts(" " + word)
        own = len(letters) + 1, len(self._ids(" " + letters))
        return (own,) if letters == word else (own, (len(word) - len(letters), len(self.pieces[word[len(letters) :]]) // 4))

    def counts(self, text: str) -> list[tuple[int, int]]:
        """Characters and tokens of each pre-token."""
        if not self.by_space:
            return list(self._counts(text))
        first, *words = text.split(" ") if is_even(text) else APART.split(text)
        return list(chain(self._counts(first), chain.from_iterable(map(self.word_counts.__getitem__, words))))

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        if self.by_space:
            first, *words = text.split(" ") if is_even(text) else APART.split(text)
            return self._pieces(first) + b"".join(map(self.words.__getitem__, words))
        if len(text) < LONG_TEXT:
            return self._pieces(text)
        found, blocks = self.pattern.finditer(text), []
        while block := [m[0] for m in islice(found, BLOCK)]:
            blocks.append(b"".join(map(self.pieces.__getitem__, block)))
        return b"".join(blocks)

    def decode(self, ids: bytes):
        """Yields (bytes, characters complete so far) of one block of ids after the other."""
        stream, numbers = Utf8Stream(), np.frombuffer(ids, "<u4")
        for at in range(0, len(numbers), BLOCK):
            chunk = b"".join(map(self.bytes_of.__getitem__, numbers[at : at + BLOCK].tolist()))
            yield chunk, stream.feed(chunk)
        if rest := stream.close():
            yield b"", rest


def codec_of(path: str, pattern: str) -> Codec:
    """One for each Python worker: its tables serve the operator's tasks until the worker turns to another operator."""
    return kept(("codec", path, pattern), lambda: Codec(path, pattern))


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None, ids: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip (the decoded text is the input).

    Null texts count as empty: no tokens, the hashes of nothing. Rows stay as they are dealt out, repeated ones too; a null
    doc_id stays null. With ids, token_ids (array of int) and decoded_text are added. Other columns of docs are not read.
    path: a vocabulary file that every executor can open; it is a parameter of the installation, not data.
    """
    pattern = pattern or public_tokenizers.PATTERN

    def fn():
        codec = codec_of(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern)

        def one(text: str | None):
            text = text or ""
            tokens = codec.encode(text)
            digest, parts = hashlib.sha256(), []
            for chunk, characters in codec.decode(tokens):
                digest.update(chunk)
                parts.append(characters)
            row = len(tokens) // 4, hashlib.sha256(tokens).hexdigest(), digest.hexdigest(), "".join(parts) == text
            return (*row, np.frombuffer(tokens, "<u4").astype("int32"), "".join(parts)) if ids else row

        def each(batch: pd.DataFrame) -> pd.DataFrame:
            columns = ["n_tokens", "ids_sha256", "decoded_sha256", "round_trip"] + ["token_ids", "decoded_text"] * ids
            out = pd.DataFrame([one(t) for t in batch["text"]], columns=columns)
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy(dtype=object))
            return out

        return each

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean" + ", token_ids array<int>, decoded_text string" * ids
    return map_rows(docs.select("doc_id", "text"), schema, fn, keeps=True)
