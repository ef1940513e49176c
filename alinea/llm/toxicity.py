"""Toxicity: subword-bag embeddings averaged into a linear softmax, both trained jointly in numpy.

A word is the bag of its character n-grams, so an unseen misspelling shares most of its vectors with the word it comes from.
Words with an insult may be few in a long text, so the average is taken over windows of words, and a text is as toxic as its
most toxic window. Windows cover all words of the text in order. A word that comes again counts again unless it stands among
the few before it, where it is in the same window anyway; so a word said over and over does not fill a window. A stretch without
blanks may be a whole text (Chinese, Thai, minified code), so a long word goes into windows as several pieces, which together
have all of its n-grams.

In training, the windows that count are chosen anew in each round: of a toxic row the one that scores highest, of a clean row
the hardest and one at random. A few dozen toxic rows must do, and nearly all n-grams of a text say nothing; so an n-gram moves
as fast as the rows bear out that it goes with a label: by the bound of its log odds over rows, which is zero for what a few
rows have by chance. The first round's windows are those in which such n-grams stand. Toxic rows come round as often as clean
ones, up to `repeats` times, until the loss no longer falls.
"""

from __future__ import annotations

import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, held_out, map_rows, slices, windows_of


@dataclass(frozen=True)
class Params:
    rows_per_class: int = 2000  # bound of the training sample: so many labelled rows of either class at most
    train_chars: int = 8000  # rows with longer texts come last into that sample, with a window of so many characters
    buckets: int = 1 << 17
    dim: int = 8
    low: int = 3
    high: int = 5
    longest: int = 64  # a word of more bytes is cut into pieces
    piece: int = 16  # bytes of such a piece; 40 of them, a window, are about as much text as 40 words
    window: int = 40
    stride: int = 20
    near: int = 10  # a word that is among so many before it does not count again; under stride, so that windows have both places
    prior: int = 100  # n-grams without meaning that each window also holds, so that short ones are not rash
    rounds: int = 24  # at most
    settled: float = 0.1  # by less of itself in four rounds the loss no longer falls
    repeats: int = 8
    doubt: float = 1.64  # standard errors that log odds must be from zero
    sure: float = 2.0  # log odds beyond that from which on an n-gram moves at full speed
    rate: float = 0.5
    lean: float = 0.005  # of the rate, for the constant: what has no evidence is to count for little
    most_words: int = 300_000  # that a task remembers, and those of one slice; a word or piece has 64 bytes at most
    seed: int = 7


def grams(word: str | bytes, p: Params) -> list[int]:
    """The buckets of a word's n-grams, or of those of a piece, which has no marks of its own."""
    marked = word if isinstance(word, bytes) else f"<{word}>".encode("utf-8", "surrogatepass")
    found = {marked[i : i + n] for n in range(p.low, p.high + 1) for i in range(len(marked) - n + 1)} or {marked}
    return [zlib.crc32(g) % p.buckets for g in found]


def pieces(words: list[str], p: Params) -> list[str | bytes]:
    """The words, in the place of a long one its pieces, each with the last high - 1 bytes of the one before it."""
    out: list[str | bytes] = []
    for word in words:
        marked = f"<{word}>".encode("utf-8", "surrogatepass") if 4 * len(word) + 2 > p.longest else b""
        if len(marked) <= p.longest:
            out.append(word)
        else:
            both = p.high - 1
            out += [marked[i : i + p.piece] for i in range(0, len(marked) - both, p.piece - both)]
    return out


def words_of(text: str | None, p: Params) -> list[str | bytes]:
    """The words in order, long ones in pieces, without those that are among the p.near before them."""
    words = (text or "").lower().split()
    if max(map(len, words), default=0) * (1 if text and text.isascii() else 4) + 2 > p.longest:
        words = pieces(words, p)
    out: list[str | bytes] = []
    last: dict[str | bytes, int] = {}
    for word in words:
        if len(out) - last.get(word, -p.near - 1) > p.near:
            last[word] = len(out)
            out.append(word)
    return out


def windows(sums: np.ndarray, counts: np.ndarray, p: Params) -> np.ndarray:
    """The mean over each window, of values given as a sum and a count for each word."""
    if not len(sums):
        return np.zeros(1)
    s, n = np.concatenate([[0.0], np.cumsum(sums)]), np.concatenate([[0.0], np.cumsum(counts)])
    starts = np.arange(0, max(1, len(sums) - p.window + p.stride), p.stride)
    ends = np.minimum(starts + p.window, len(sums))
    return (s[ends] - s[starts]) / (n[ends] - n[starts] + p.prior)


def fit(texts: list[str], labels: list[int], p: Params) -> tuple[np.ndarray, float]:
    """The trained model, folded: what each n-gram adds to the log odds of a window that it fills, and the log odds without any.

    Without rows of both classes it is a constant: certain of the one class that there is, of label 0 without any.
    """
    y = np.array(labels, dtype=float)
    if not len(y) or y.min() == y.max():
        return np.zeros(p.buckets), (20.0 if len(y) and y[0] else -20.0)
    rng = np.random.default_rng(p.seed)
    seen: dict[str | bytes, int] = {}
    bags, sizes = array("i"), array("i")  # buckets of all words, one word after the other, and how many each has
    rows = []
    for text in texts:
        ids = []
        for word in words_of(text, p):
            if word not in seen:
                seen[word] = len(sizes)
                own = grams(word, p)
                bags.extend(own)
                sizes.append(len(own))
            ids.append(seen[word])
        rows.append(np.array(ids, dtype=int))
    sizes = np.array(sizes or [1], dtype=int)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    flat = np.array(bags or [0], dtype="int32")
    some = [k for k in range(len(rows)) if len(rows[k])]

    def bag(words: np.ndarray) -> np.ndarray:
        return np.concatenate([flat[starts[w] : starts[w] + sizes[w]] for w in words])

    bound = evidence([np.unique(bag(np.unique(rows[k]))) for k in some], y[some], p)
    speed = np.minimum(1, np.abs(bound) / p.sure)
    table = rng.normal(0, 1 / p.dim, (p.buckets, p.dim)) * speed[:, None]
    out, bias = np.zeros((p.dim, 2)), np.zeros(2)
    folded, losses = np.maximum(bound, 0), []
    times = max(1, min(p.repeats, int((1 - y).sum() // y.sum())))
    visits = np.concatenate([[k] * (times if y[k] else 1) for k in some]).astype(int) if some else np.array([], int)
    for epoch in range(p.rounds):
        sums = np.add.reduceat(folded[flat], starts)
        rate, loss, n = p.rate * (1 - epoch / p.rounds), 0.0, 0
        for k in rng.permutation(visits):
            ids, label = rows[k], int(y[k])
            means = windows(sums[ids], sizes[ids], p)
            places = [int(np.argmax(means))] + ([] if label else [int(rng.integers(len(means)))])
            for at in places:
                words = bag(ids[at * p.stride : at * p.stride + p.window])
                size, words = len(words) + p.prior, words[speed[words] > 0]
                hidden = table[words].sum(0) / size
                logits = hidden @ out + bias
                odds = np.exp(logits - logits.max())
                wrong = odds / odds.sum()
                loss, n = loss - np.log(max(wrong[label], 1e-12)), n + 1
                wrong[label] -= 1
                step = out @ wrong
                out -= rate * np.outer(hidden, wrong)
                bias -= rate * p.lean * wrong
                np.subtract.at(table, words, 20 * rate * speed[words][:, None] * step / size)
        folded = table @ (out[:, 1] - out[:, 0])
        losses.append(loss / max(n, 1))
        if epoch >= max(4, p.rounds // 3) and losses[-1] > (1 - p.settled) * losses[-5]:
            break
    return folded, float(bias[1] - bias[0])


def evidence(bags: list[np.ndarray], y: np.ndarray, p: Params) -> np.ndarray:
    """For each bucket the log odds of label 1 in the rows that have it, moved towards zero by p.doubt standard errors, not past it."""
    seen = np.zeros((2, p.buckets))
    for own, label in zip(bags, y.astype(int), strict=True):
        seen[label, own] += 1
    size = np.array([(1 - y).sum(), y.sum()])[:, None] + 1
    odds = np.log((seen[1] + 0.5) / size[1]) - np.log((seen[0] + 0.5) / size[0])
    error = np.sqrt((1 / (seen + 0.5)).sum(0))
    return np.sign(odds) * np.maximum(0, np.abs(odds) - p.doubt * error)


def train(docs: DataFrame, labels: DataFrame, p: Params) -> tuple[np.ndarray, float]:
    """Fits on at most rows_per_class rows of either class, in the order of a hash of doc_id; held-out rows are never read."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1)").filter(~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id", F.lit(p.seed))
    drawn = [known.filter(F.col("toxic") == k).orderBy(order, "doc_id").limit(2 * p.rows_per_class) for k in (0, 1)]
    picked = {r.doc_id: r.toxic for d in drawn for r in d.collect()}
    if not picked:
        return fit([], [], p)
    spark = docs.sparkSession
    ids = F.broadcast(spark.createDataFrame([(k,) for k in picked], "doc_id long"))
    texts = {r.doc_id: (r.long, r.text) for r in windows_of(docs.join(ids, "doc_id", "left_semi"), p.train_chars, p.seed).collect()}
    rows = []
    for k in (0, 1):
        rows += [(i, texts[i][1]) for i in sorted(texts, key=lambda i: (texts[i][0], i)) if picked[i] == k][: p.rows_per_class]
    return fit([t for _, t in rows], [picked[i] for i, _ in rows], p)


def crc_table() -> np.ndarray:
    """What one byte does to a crc32."""
    out = np.arange(256, dtype="uint32")
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1)
    return out


def all_grams(words: list[str | bytes], p: Params) -> tuple[np.ndarray, np.ndarray]:
    """(place of the word, bucket) of each n-gram that grams() finds, for many words at once: all begin at one byte after the other."""
    marked = [w if isinstance(w, bytes) else f"<{w}>".encode("utf-8", "surrogatepass") for w in words]
    sizes = np.fromiter(map(len, marked), "int64", len(marked))
    data = np.frombuffer(b"".join(marked) + bytes(p.high), "uint8")
    owner = np.repeat(np.arange(len(marked)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(owner))  # bytes from here to the word's end
    table, crc, found = crc_table(), np.full(len(owner), 0xFFFFFFFF, "uint32"), []
    for n in range(1, p.high + 1):
        crc = table[(crc ^ data[n - 1 : n - 1 + len(owner)]) & 0xFF] ^ (crc >> 8)
        if n >= p.low:
            on = left >= n
            found.append((owner[on] << 32) | (crc[on] ^ np.uint32(0xFFFFFFFF)))
    short = np.flatnonzero(sizes < p.low)  # too short for any: the whole is one
    found.append(np.array([(k << 32) | zlib.crc32(marked[k]) for k in short.tolist()], "int64"))
    pairs = np.sort(np.concatenate(found))
    pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])] if len(pairs) else pairs
    return pairs >> 32, (pairs & 0xFFFFFFFF) % p.buckets


class Scorer:
    """Log odds of texts' most toxic windows. What a word adds is kept, until too many are."""

    def __init__(self, model: tuple[np.ndarray, float], p: Params) -> None:
        self.folded, self.start = model
        self.p = p
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str | bytes, int] = {}
        self.sums, self.counts = np.array([]), np.array([])

    def many(self, texts: list[str | None]) -> np.ndarray:
        if len(self.place) > self.p.most_words:
            self._forget()
        each = [words_of(t, self.p) for t in texts]
        new = [w for w in dict.fromkeys(w for words in each for w in words) if w not in self.place]
        for at in range(0, len(new), 20_000):  # so many words' n-grams at once
            some = new[at : at + 20_000]
            owner, bucket = all_grams(some, self.p)
            self.place.update(zip(some, range(len(self.place), len(self.place) + len(some)), strict=True))
            self.sums = np.concatenate([self.sums, np.bincount(owner, self.folded[bucket], len(some))])
            self.counts = np.concatenate([self.counts, np.bincount(owner, minlength=len(some))])
        out = np.zeros(len(each))
        for k, words in enumerate(each):
            at = np.fromiter(map(self.place.__getitem__, words), "int64", len(words))
            out[k] = windows(self.sums[at], self.counts[at], self.p).max() + self.start
        return out

    def __call__(self, text: str | None) -> float:
        return float(self.many([text])[0])


def log_odds(model: tuple[np.ndarray, float], p: Params) -> Scorer:
    """A function from a text to the log odds of its most toxic window."""
    return Scorer(model, p)


def score(docs: DataFrame, model: tuple[np.ndarray, float], p: Params = Params()) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from 0.5 on) for each row of docs; null and empty texts get the score of no words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 8 bytes a bucket, whatever the input

    def fn():
        of = log_odds(shared.value, p)

        def each(batch: pd.DataFrame) -> pd.DataFrame:
            scores = 1 / (1 + np.exp(-np.clip(of.many(batch["text"].tolist()), -30, 30)))
            return pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64").to_numpy(dtype=object), "score": scores, "predicted": (scores >= 0.5).astype(int)})

        return each

    return map_rows(docs.select("doc_id", "text"), "doc_id long, score double, predicted int", fn)


def toxicity(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Learns from labels.toxic (0 or 1; other values are left out; of several labels of an id the higher counts, of several texts the smallest) of rows that are not
    held out. A score depends on the text alone. Null doc_ids are scored and count as not held out.
    """
    scored = score(docs, train(docs, labels, p), p)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """docs without the rows that the classifier rejects (score of 0.5 or more); all columns of docs stay."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, p))

    def kept(batches):
        forget()
        of = log_odds(shared.value, p)
        for batch in batches:
            for some in slices(batch):
                yield some.filter(pa.array(of.many(some.column("text").to_pylist()) < 0, "bool"))
        del of
        forget()

    return docs.mapInArrow(kept, docs.schema)
