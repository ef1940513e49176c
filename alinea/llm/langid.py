"""Language identification: a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

The network labels every byte position. It reads one word at a time (its bytes between blanks, its state starts afresh with
each), so that a word's labels are the same wherever it stands and each distinct word is worked out once. A document's
probabilities are pooled from all positions of all its words: the mean of their log probabilities, normalised.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, map_rows, windows_of


@dataclass(frozen=True)
class Params:
    rows_per_language: int = 300  # bound of the training sample
    train_chars: int = 6000  # rows with longer texts come last into that sample, with a window of so many characters
    words_per_language: int = 12_000  # words drawn from them for training
    hidden: int = 12
    steps: int = 600
    batch: int = 256
    rate: float = 0.02
    longest: int = 24  # a longer word is read as several of so many bytes
    most_words: int = 150_000  # words that a task remembers at once
    block_chars: int = 2_000_000  # texts are taken together up to so many characters
    seed: int = 11


def pieces(word: str, p: Params) -> list[bytes]:
    marked = b" " + word.encode("utf-8", "surrogatepass") + b" "
    return [marked[i : i + p.longest] for i in range(0, len(marked), p.longest)]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class BiGru:
    """Weights of both directions: x (256 x 3h: what each byte adds), u (h x 3h), and out (2h x labels), bias."""

    def __init__(self, hidden: int, labels: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.h = hidden
        self.w = {f"{k}{d}": rng.normal(0, s, shape).astype("float32") for d in "fb" for k, s, shape in (("x", 0.3, (256, 3 * hidden)), ("u", 0.3, (hidden, 3 * hidden)))}
        self.w |= {"out": rng.normal(0, 0.3, (2 * hidden, labels)).astype("float32"), "bias": np.zeros(labels, "float32")}

    def _run(self, codes: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """codes: batch x time. Returns the hidden states, batch x time x h, and what the way back needs."""
        n, steps, h = *codes.shape, self.h
        x, u, state = self.w[f"x{d}"], self.w[f"u{d}"], np.zeros((n, self.h), "float32")
        states, saved = np.empty((n, steps, h), "float32"), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a, b = x[codes[:, t]], state @ u
            gates = sigmoid(a[:, : 2 * h] + b[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            new = np.tanh(a[:, 2 * h :] + r * b[:, 2 * h :])
            if keep:
                saved.append((t, state, z, r, new, b[:, 2 * h :]))
            state = new + z * (state - new)
            states[:, t] = state
        return states, saved

    def log_probabilities(self, codes: np.ndarray, keep: bool = False):
        (f, sf), (b, sb) = self._run(codes, "f", keep), self._run(codes, "b", keep)
        both = np.concatenate([f, b], axis=2)
        logits = both @ self.w["out"] + self.w["bias"]
        logits -= logits.max(axis=2, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=2, keepdims=True)), both, {"f": sf, "b": sb}

    def gradients(self, codes: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy over all positions, by backpropagation through time."""
        log_p, both, saved = self.log_probabilities(codes, True)
        n, steps, _ = log_p.shape
        wrong = np.exp(log_p)
        wrong[np.arange(n)[:, None], np.arange(steps)[None], labels[:, None]] -= 1
        wrong /= n * steps
        grads = {"out": np.einsum("nth,ntl->hl", both, wrong), "bias": wrong.sum((0, 1))}
        into, h = wrong @ self.w["out"].T, self.h
        for k, d in enumerate("fb"):
            u = self.w[f"u{d}"]
            gx, gu = np.zeros((256, 3 * h), "float32"), np.zeros_like(u)
            back = np.zeros((n, h), "float32")
            for t, before, z, r, new, recurrent in reversed(saved[d]):
                g = back + into[:, t, k * h : (k + 1) * h]
                g_new = g * (1 - z) * (1 - new * new)
                g_z = g * (before - new) * z * (1 - z)
                g_r = g_new * recurrent * r * (1 - r)
                a = np.concatenate([g_z, g_r, g_new], axis=1)
                b = np.concatenate([g_z, g_r, g_new * r], axis=1)
                np.add.at(gx, codes[:, t], a)
                gu += before.T @ b
                back = g * z + b @ u.T
            grads |= {f"x{d}": gx, f"u{d}": gu}
        return grads

    def label(self, words: list[bytes], n_labels: int, batch: int = 4096) -> np.ndarray:
        """For each word the sums of its positions' log probabilities, and how many positions it has."""
        out = np.zeros((len(words), n_labels + 1), "float32")
        lengths = np.fromiter(map(len, words), int, len(words))
        order = np.argsort(lengths, kind="stable")
        for steps in np.unique(lengths[lengths > 0]):
            same = order[np.searchsorted(lengths[order], steps) : np.searchsorted(lengths[order], steps, "right")]
            for at in range(0, len(same), batch):
                some = same[at : at + batch]
                codes = np.frombuffer(b"".join([words[i] for i in some]), "uint8").reshape(len(some), steps)
                out[some, :-1] = self.log_probabilities(codes)[0].sum(axis=1)
                out[some, -1] = steps
        return out


def fit(texts: list[str], langs: list[str], p: Params) -> tuple[list[str], BiGru | None]:
    """The learned languages in order, and the network; none where there is nothing to learn from."""
    names = sorted(set(langs))
    if not names:
        return [], None
    rng = np.random.default_rng(p.seed)
    words, labels = [], []
    for k, name in enumerate(names):
        own = [w for t, lang in zip(texts, langs, strict=True) if lang == name for w in dict.fromkeys(t.split()) if has_letter(w)]
        for i in rng.permutation(len(own))[: p.words_per_language]:
            for piece in pieces(own[i], p):
                words.append(piece)
                labels.append(k)
    net = BiGru(p.hidden, len(names), p.seed)
    lengths, labels = np.fromiter(map(len, words), int, len(words)), np.array(labels)
    by_length = {n: np.where(lengths == n)[0] for n in np.unique(lengths)}
    if not by_length:
        return names, net
    sizes = list(by_length)
    share = np.array([len(by_length[n]) * n for n in sizes], float)
    first, second = ({k: np.zeros_like(v) for k, v in net.w.items()} for _ in range(2))
    for step in range(1, p.steps + 1):
        n = sizes[rng.choice(len(sizes), p=share / share.sum())]
        some = rng.choice(by_length[n], min(p.batch, len(by_length[n])))
        codes = np.frombuffer(b"".join([words[i] for i in some]), "uint8").reshape(len(some), n)
        rate = p.rate * (1 - step / (p.steps + 1))
        for k, g in net.gradients(codes, labels[some]).items():  # Adam
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            net.w[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return names, net


def sample(docs: DataFrame, p: Params) -> DataFrame:
    """At most rows_per_language rows of each language, in the order of a hash of doc_id; held-out rows are never among them.

    The best of each of 64 parts of a language are drawn before the best of the language, so that no task gets all its rows.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id"))
    ranked = known.select("doc_id", "lang", (F.length("text") > p.train_chars).alias("long"), F.xxhash64("doc_id", F.lit(p.seed)).alias("draw"))
    ranked = ranked.withColumn("part", F.pmod("draw", F.lit(64)))
    for keys in (["lang", "part"], ["lang"]):
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("long", "draw", "doc_id", "lang"))).filter(F.col("rank") <= p.rows_per_language)
    return ranked.groupBy("doc_id").agg(F.min("lang").alias("lang"))


def train(docs: DataFrame, p: Params) -> tuple[list[str], BiGru | None]:
    drawn = {r.doc_id: r.lang for r in sample(docs, p).collect()}
    if not drawn:
        return [], None
    ids = F.broadcast(docs.sparkSession.createDataFrame([(k,) for k in drawn], "doc_id long"))
    texts = {r.doc_id: r.text for r in windows_of(docs.join(ids, "doc_id", "left_semi"), p.train_chars, p.seed).collect()}
    order = sorted(texts)
    return fit([texts[i] for i in order], [drawn[i] for i in order], p)


def identify(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score (the pooled probability of lang_pred).

    Learns from text and lang of rows that are not held out and whose lang is not null; of a repeated doc_id the smallest text and language count.
    lang_pred is `und`, with score 0, where text is null or without a letter, and everywhere if there is nothing to learn from.
    Ties go to the language that sorts first. Null doc_ids are labelled and count as not held out.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, p))  # a few kB for each language

    def fn():
        names, net = model.value
        known: dict[str, int] = {}
        values = np.zeros((0, len(names) + 1), "float32")

        def block(texts: list[str | None]) -> list[tuple[str, float]]:
            nonlocal known, values
            lists = [(t or "").split() for t in texts]
            new = list(dict.fromkeys(w for ws in lists for w in ws if w not in known))
            if len(known) + len(new) > p.most_words:
                known, new = {}, list(dict.fromkeys(w for ws in lists for w in ws))
                values = values[:0]
            cut = [pieces(w, p) if has_letter(w) else [b""] for w in new]  # words without a letter add nothing
            flat = net.label([c for cs in cut for c in cs], len(names)) if new else values[:0]
            if new:
                starts = np.cumsum([0] + [len(c) for c in cut[:-1]])
                known |= zip(new, range(len(known), len(known) + len(new)), strict=True)
                values = np.concatenate([values, np.add.reduceat(flat, starts, axis=0)])
            out = []
            for ws in lists:
                total = values[np.fromiter(map(known.__getitem__, ws), int, len(ws))].sum(axis=0, dtype=float)
                if not total[-1]:
                    out.append(("und", 0.0))
                    continue
                mean = total[:-1] / total[-1]
                share = np.exp(mean - mean.max())
                best = int(np.argmax(share))
                out.append((names[best], float(share[best] / share.sum())))
            return out

        def each(batch: pd.DataFrame) -> pd.DataFrame:
            texts, found, some, size = list(batch["text"]), [], [], 0
            for text in texts if net else []:
                some.append(text)
                size += len(text or "")
                if size >= p.block_chars:
                    found += block(some)
                    some, size = [], 0
            found += block(some) if net else [("und", 0.0)] * len(texts)
            return pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64").to_numpy(dtype=object), "lang_pred": [x for x, _ in found], "score": [x for _, x in found]})

        return each

    scored = map_rows(docs.select("doc_id", "text"), "doc_id long, lang_pred string, score double", fn)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
