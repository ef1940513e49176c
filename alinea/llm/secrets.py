"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds what looks like them.

The field tags the tokens of a text as begin, inside or outside of a secret, by each token's shape, its neighbours and features
of the file, and is decoded by Viterbi. It learns from windows of a bounded sample of texts: from what the patterns find there,
once as it stands and once with its keyword hidden, and from made-up secrets and harmless look-alikes that are put among the
texts' own tokens. So shape and neighbours carry a secret that no pattern takes, and numbers, addresses or names do not.

Most tokens are ordinary words. Where a token's own score for outside exceeds its others by more than all neighbours, file
features and transitions can make up for, every best path has it outside; decoding runs on what lies between such tokens and
gives the same path as over the whole text. Whether a word is of that kind is remembered.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import hashlib
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, forget, map_rows, slices

# The patterns of the base scan, their least lengths, and the order of kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "crf")

LONG_HEX = re.compile(r"[0-9a-f]{32}")
HINTS = ("passw", "secret", "token", "apikey", "api_key")
WORD = re.compile(r"\S+")
TOKEN = re.compile(r"[\w+/.-]+|[^\w\s+/.-]")
BEGIN, INSIDE, OUTSIDE = range(3)


@dataclass(frozen=True)
class Params:
    sample_rows: int = 4000  # bound of the training sample
    train_chars: int = 6000  # of a longer text the sample has a window of so many characters, chosen by hash
    own: int = 1 << 13
    context: int = 1 << 11
    width: int = 20  # tokens of a training window
    quiet: int = 4  # windows without a secret for each one with
    rounds: int = 60
    rate: float = 0.1
    decay: float = 3e-4
    most_words: int = 200_000
    seed: int = 5


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns, by start, then by kind as listed."""
    found = []
    low = text.lower()
    if any(h in low for h in HINTS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    if max(map(len, text.split()), default=0) >= LEAST["hex"] and LONG_HEX.search(text):
        found += [("hex", m.start(), m.end()) for m in HEX.finditer(text) if len(m[0]) >= LEAST["hex"]]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def code(kind: str, value, size: int) -> int:
    return zlib.crc32(f"{kind}\0{value}".encode("utf-8", "surrogatepass")) % size


def kind_of(token: str) -> str:
    """A token as its neighbours see it: short words by name, all else by shape."""
    if len(token) <= 12 and token.isalpha():
        return token.lower()
    return token if len(token) == 1 else "".join(sorted({"d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else c for c in token}))


LOWER_RUN, CLASS_RUN = re.compile(r"[a-z]+"), re.compile(r"[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+")


def shape_of(token: str) -> tuple:
    """What a token looks like, apart from its name: the same for most words.

    Names and paths have long runs of small letters and few changes of kind, random signs short runs and many changes.
    """
    n = len(token)
    if token.isalpha() and token.islower():
        digits, letters, upper, shape, run, changes = 0, n, 0, "word", n, 1
    else:
        digits, upper, letters = sum(map(str.isdigit, token)), sum(map(str.isupper, token)), sum(map(str.isalpha, token))
        shape = "word" if letters == n else kind_of(token)
        run, changes = max(map(len, LOWER_RUN.findall(token)), default=0), len(CLASS_RUN.findall(token))
    size = min(n, 40) // 4
    return size, -(-4 * digits // n), -(-4 * upper // n), -(-4 * letters // n), shape, len(set(token)) * 4 // n, token.isascii(), (n >= 16, digits > 0, letters > 0), min(run, 7), (8 * changes // n, n >= 16), (min(run, 7), size)


SHAPES = ("size", "digits", "upper", "letters", "shape", "kinds", "ascii", "long", "run", "changes", "run and size")


def may_be_secret(token: str) -> bool:
    """A token that nobody has marked as a secret, and nobody as none."""
    return len(token) >= 12 and any(map(str.isdigit, token)) and any(map(str.isalpha, token))


def own_features(token: str, p: Params) -> list[int]:
    return [code(k, v, p.own) for k, v in zip(SHAPES, shape_of(token), strict=True)] + [code("name", kind_of(token), p.own)]


def file_features(text: str) -> list[int]:
    """Slots of 8 and 8: the text's length, and which signs of code it has."""
    return [min(7, len(text).bit_length() // 3), 8 + ("=" in text) + 2 * ("{" in text) + 4 * (";" in text)]


class Field:
    """Weights for the states begin, inside and outside: own, of the neighbours (two before, one after), file; and steps."""

    def __init__(self, p: Params) -> None:
        self.p = p
        self.w = {"own": np.zeros((p.own, 3)), "before": np.zeros((p.context, 3)), "further": np.zeros((p.context, 3)), "after": np.zeros((p.context, 3)), "file": np.zeros((16, 3)), "step": np.zeros((3, 3))}
        self.w["own"][:, OUTSIDE] = 1e-3

    def freeze(self) -> None:
        """What neighbours, file and steps can add at most to a state other than outside."""
        slots = sum((self.w[k][:, :2].max(1) - self.w[k][:, 2]).max() for k in ("before", "further", "after"))
        slots += 2 * (self.w["file"][:, :2].max(1) - self.w["file"][:, 2]).max()
        self.reach = slots + 2 * (self.w["step"].max() - self.w["step"].min())
        self.shapes = Memo(lambda x: self.w["own"][[code(k, v, self.p.own) for k, v in zip(SHAPES, x, strict=True)]].sum(0), 20_000)
        self.own = Memo(lambda t: self.shapes[shape_of(t)] + self.w["own"][code("name", kind_of(t), self.p.own)], self.p.most_words // 4)
        self.near = {k: Memo(lambda t, k=k: self.w[k][code(k, kind_of(t), self.p.context)], 20_000) for k in ("before", "further", "after")}
        self.doubtful = Memo(self._doubtful, self.p.most_words)

    def settled(self, token: str) -> bool:
        begin, inside, outside = self.own[token].tolist()
        return outside - max(begin, inside) > self.reach

    def _doubtful(self, word: str) -> bool:
        return not all(self.settled(t) for t in TOKEN.findall(word))

    def spans(self, text: str) -> list[tuple[int, int]]:
        words = text.split()
        at = [k for k, d in enumerate(map(self.doubtful.__getitem__, words)) if d]
        if not at:
            return []
        wanted = sorted({k + d for k in at for d in (-2, -1, 0, 1)} & {*range(len(words))})
        places, chosen = [m.span() for m in WORD.finditer(text)], {*at}
        tokens = []  # (start, end, token, its word) of doubtful words and of those around
        for k in wanted:
            a, b = places[k]
            tokens += [(m.start(), m.end(), m[0], k) for m in TOKEN.finditer(text, a, b)]
        file = self.w["file"][file_features(text)].sum(0)
        out: list[tuple[int, int]] = []
        run: list[tuple[int, int, np.ndarray]] = []

        def close() -> None:
            if run:
                out.extend(self._decoded(run))
                run.clear()

        for i, (a, b, token, k) in enumerate(tokens):
            if k not in chosen or self.settled(token):
                close()
                continue
            before = tokens[i - 1] if i and k - tokens[i - 1][3] <= 1 else None
            further = tokens[i - 2] if i > 1 and before and before[3] - tokens[i - 2][3] <= 1 else None
            after = tokens[i + 1] if i + 1 < len(tokens) and tokens[i + 1][3] - k <= 1 else None
            score = self.own[token] + file
            for name, other in (("before", before), ("further", further), ("after", after)):
                score = score + self.near[name][other[2] if other else ""]
            if run and before is None:
                close()
            run.append((a, b, score))
        close()
        return out

    def _decoded(self, run: list[tuple[int, int, np.ndarray]]) -> list[tuple[int, int]]:
        """Viterbi over tokens that stand between settled ones (or the text's ends), which are outside."""
        step, back = self.w["step"], []
        best = step[OUTSIDE] + run[0][2]
        for _, _, score in run[1:]:
            ways = best[:, None] + step
            back.append(ways.argmax(0))
            best = ways.max(0) + score
        state = int((best + step[:, OUTSIDE]).argmax())
        states = [state]
        for way in reversed(back):
            states.append(state := int(way[state]))
        out: list[list[int]] = []
        last = OUTSIDE
        for (a, b, _), state in zip(run, reversed(states), strict=True):
            if state == BEGIN or state == INSIDE and last == OUTSIDE:
                out.append([a, b])
            elif state == INSIDE:
                out[-1][1] = b
            last = state
        return [(a, b) for a, b in out]


SIGNS = {"hex": "0123456789abcdef", "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"}
NAMES = ("credential", "bearer", "auth", "authorization", "pwd", "key", "private", "signature", "session", "cookie", "access", "client")


def made_up(rng: np.random.Generator) -> tuple[list[str], list[int]]:
    """Tokens of a secret as it may stand in a text, and their tags."""
    signs = SIGNS[str(rng.choice(list(SIGNS)))]
    short = rng.random() < 0.3  # such a one is a secret only by the name and sign before it
    value = "".join(rng.choice(list(signs), int(rng.integers(10, 18) if short else rng.integers(16, 65))))
    while not any(map(str.isdigit, value)) or not any(map(str.isalpha, value)):
        value = value[:-2] + "7f"
    value = value.strip("+/-_") or "7f" * 8
    if not short and rng.random() < 0.2:  # in several groups, of which some are numbers
        groups = ["".join(rng.choice(list(SIGNS["hex"][:10] if rng.random() < 0.6 else signs), int(rng.integers(6, 15)))) for _ in range(int(rng.integers(1, 3)))]
        value = str(rng.choice(list("-_."))).join([*groups, value])
    if not short and rng.random() < 0.35:  # a short prefix that names the issuer
        value = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(rng.integers(2, 5)))) + str(rng.choice(["_", "-"])) + value
    lead = [["="], [":"], ["=", '"'], [":", '"'], ["=", "'"], [], [], ['"']][int(rng.integers(5 if short else 8))]
    name = [str(rng.choice(NAMES))] if short or rng.random() < 0.5 else []
    quote = [q for q in lead if q in "\"'"]
    return name + lead + [value] + quote, [OUTSIDE] * (len(name) + len(lead)) + [BEGIN] + [OUTSIDE] * len(quote)


def harmless(rng: np.random.Generator) -> list[str]:
    """Tokens that look a little like a secret, or stand where one may."""
    digits = lambda n: "".join(rng.choice(list("0123456789"), n))
    word = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))
    n = int(rng.integers(6, 20))
    signs = lambda kind, n: "".join(rng.choice(list(SIGNS[kind]), n))
    named = lambda: "".join(word(int(rng.integers(3, 9))).title() for _ in range(int(rng.integers(1, 4))))
    uuid = "-".join(signs("hex", k) for k in (8, 4, 4, 4, 12))
    more = [
        [uuid], [uuid.upper() if rng.random() < 0.5 else uuid], [word(int(rng.integers(3, 8))) + named() + digits(int(rng.integers(1, 3))) + (named() if rng.random() < 0.5 else "")], [word(int(rng.integers(3, 8))) + named() + digits(1)], [word(int(rng.integers(2, 5))) + named() + named() + digits(1) + named()],
        [signs("letters", 2).upper() + digits(int(rng.integers(13, 22)))], [chr(65 + int(rng.integers(26))) + chr(65 + int(rng.integers(26))) + digits(2), *(digits(4) for _ in range(4))],
        ["/".join([word(4), word(int(rng.integers(3, 9))) + digits(int(rng.integers(1, 3))) + "." + digits(2), word(5) + "-" + word(8), word(7) + "_" + digits(1) + ".so"])], [f"/{word(3)}/{word(3)}/lib{word(6)}.so.{digits(1)}.{digits(2)}"],
        [word(5) + "/" + signs("hex", int(rng.integers(7, 13)))], [signs("base64", int(rng.integers(8, 15))).strip("+/-_") or "a1"], [signs("letters", int(rng.integers(8, 15)))], [signs("letters", int(rng.integers(8, 13)))], [word(int(rng.integers(3, 7))) + "_" + word(int(rng.integers(3, 9))) + "_v" + digits(2) + "_" + word(5)], [word(5) + digits(3) + "-" + word(6) + "-" + digits(4)],
    ]
    if rng.random() < 0.6:
        found = more[int(rng.integers(len(more)))]
        lead = [[], [], ["="], [":"], ["=", '"']][int(rng.integers(5))]
        return ([word(int(rng.integers(2, 9)))] if lead else []) + lead + found
    found = [
        [digits(n)], [word(5) + "." + digits(2), "@", word(6) + digits(1) + ".example.com"], [f"v{digits(1)}.{digits(2)}.{digits(1)}"], [f"20{digits(2)}-0{digits(1)}-1{digits(1)}"],
        [f"{word(4)}/{word(6)}/{word(5)}{digits(1)}.html"], [f"{word(5)}_{word(6)}_{digits(1)}"], [word(n + 6)], [word(n).upper()], [f"{digits(3)}-{digits(3)}-{digits(4)}"], [word(n).title() + word(4).title()],
        [digits(4), digits(4), digits(4)], [f"{word(8)}-{word(5)}"],
    ][int(rng.integers(12))]
    lead = [[], [], ["="], [":"], ["=", '"']][int(rng.integers(5))]
    return ([str(rng.choice(NAMES))] if lead and rng.random() < 0.5 else []) + lead + found


UNKNOWN = -1


def windows(texts: list[str], p: Params) -> tuple[list, np.ndarray]:
    """Training windows: for each its tokens' features (own, before, further, after, file), and the states.

    What looks like a secret and is in no span of the patterns has the state UNKNOWN: that nobody has marked it does not say
    that it is none.
    """
    rng = np.random.default_rng(p.seed)
    rows, states = [], []

    def add(tokens: list[str], tags: list[int], start: int, file: list[int]) -> None:
        name = lambda i, slot: code(slot, kind_of(tokens[i]) if 0 <= i < len(tokens) else "", p.context)
        rows.append([(own_features(tokens[i], p), name(i - 1, "before"), name(i - 2, "further"), name(i + 1, "after"), file) for i in range(start, start + p.width)])
        states.append(tags[start : start + p.width])

    for text in texts:
        spans = []
        for kind, a, b in base_spans(text):
            spans.append((m.start(2), m.end(2)) if kind == "assign" and (m := ASSIGN.match(text, a)) else (a, b))
        found = [(m.start(), m.end(), m[0]) for m in TOKEN.finditer(text)]
        if len(found) < p.width:
            continue
        tokens = [t for _, _, t in found]
        tags = [UNKNOWN if may_be_secret(t) else OUTSIDE for t in tokens]
        for a, b in spans:
            inside = [i for i, t in enumerate(found) if t[0] < b and t[1] > a]
            for i in inside:
                tags[i] = BEGIN if i == inside[0] else INSIDE
        file, last = file_features(text), len(tokens) - p.width
        starts = [max(0, min(i - int(rng.integers(2, p.width - 2)), last)) for i, t in enumerate(tags) if t == BEGIN]
        hidden = [str(rng.choice(tokens)) if any(h in t.lower() for h in HINTS) else t for t in tokens] if starts else tokens
        for s in starts:
            add(tokens, tags, s, file)
            add(hidden, tags, s, file)
        for s in rng.integers(0, last + 1, p.quiet * len(starts) if starts else int(rng.random() < 0.5)):
            add(tokens, tags, int(s), file)
            more, their = made_up(rng) if rng.random() < 0.5 else (harmless(rng), [])
            at = int(s) + int(rng.integers(1, p.width - len(more) - 1))
            mixed, with_tags = tokens[:at] + more + tokens[at:], tags[:at] + (their or [OUTSIDE] * len(more)) + tags[at:]
            add(mixed, with_tags, int(s), file)
    return rows, np.array(states, int).reshape(-1, p.width)


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    """log of the sum of exponentials; states that are not allowed have -inf."""
    top = x.max(axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def expected(score: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For windows' scores (window, token, state): the probability of each state at each token, and the expected number of each step."""
    n, width, _ = score.shape
    forward, backward = np.zeros((width, n, 3)), np.zeros((width, n, 3))
    forward[0] = score[:, 0]
    for t in range(1, width):
        forward[t] = log_sum(forward[t - 1][:, :, None] + step, 1) + score[:, t]
    for t in range(width - 2, -1, -1):
        backward[t] = log_sum(step + (score[:, t + 1] + backward[t + 1])[:, None, :], 2)
    total = log_sum(forward[-1], 1)
    pairs = np.zeros((3, 3))
    for t in range(width - 1):
        pairs += np.exp(forward[t][:, :, None] + step + (score[:, t + 1] + backward[t + 1])[:, None, :] - total[:, None, None]).sum(0)
    return np.exp(forward + backward - total[:, None]).transpose(1, 0, 2), pairs


def fit(texts: list[str], p: Params) -> Field:
    """Maximum likelihood by Adam; forward and backward sums over all windows at once. Without a secret to learn from it adds none.

    The likelihood is that of all paths that agree with the known states: an unknown one may be any.
    """
    field = Field(p)
    rows, states = windows(texts, p)
    if not len(rows) or not (states != OUTSIDE).any() or not (states == BEGIN).any():
        field.w["own"][:, OUTSIDE] = 1.0
        return field
    n, width = states.shape
    own = np.array([[t[0] for t in r] for r in rows])
    near = {k: np.array([[t[i] for t in r] for r in rows]) for i, k in ((1, "before"), (2, "further"), (3, "after"))}
    file = np.array([[t[4] for t in r] for r in rows])
    first, second = ({k: np.zeros_like(v) for k, v in field.w.items()} for _ in range(2))
    allowed = np.where((states == UNKNOWN)[:, :, None], 0.0, np.where(np.eye(3)[states] > 0, 0.0, -np.inf))
    open_ = np.flatnonzero((states == UNKNOWN).any(1))  # windows in which more than one path agrees with what is known
    for turn in range(1, p.rounds + 1):
        w = field.w
        score = w["own"][own].sum(2) + w["file"][file].sum(2) + sum(w[k][v] for k, v in near.items())
        seen, pairs = expected(score, w["step"])
        truth, true_pairs = np.eye(3)[states], sum(np.eye(3)[states[:, t]].T @ np.eye(3)[states[:, t + 1]] for t in range(width - 1))
        if len(open_):
            known, known_pairs = expected(score[open_] + allowed[open_], w["step"])
            true_pairs = true_pairs + known_pairs - sum(truth[open_, t].T @ truth[open_, t + 1] for t in range(width - 1))
            truth[open_] = known
        wrong = seen - truth
        grads = {k: np.zeros_like(v) for k, v in w.items()}
        for k in range(own.shape[2]):
            np.add.at(grads["own"], own[:, :, k], wrong)
        for k in range(2):
            np.add.at(grads["file"], file[:, :, k], wrong)
        for k, v in near.items():
            np.add.at(grads[k], v, wrong)
        grads["step"] += pairs - true_pairs
        for k, g in grads.items():
            g = g / n + p.decay * w[k]
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            w[k] = w[k] - p.rate * (first[k] / (1 - 0.9**turn)) / (np.sqrt(second[k] / (1 - 0.99**turn)) + 1e-6)
        field.w = w
    return field


def train(docs: DataFrame, p: Params) -> Field:
    """From at most sample_rows texts, in the order of a hash of doc_id and text."""
    drawn = docs.select("text", F.xxhash64("doc_id", "text", F.lit(p.seed)).alias("draw")).filter(F.length("text") > 0)
    start = F.pmod("draw", F.greatest(F.lit(1), F.length("text") - p.train_chars + 1)) + 1
    drawn = drawn.select("draw", F.substring("text", start.cast("int"), F.lit(p.train_chars)).alias("text"))
    first = [r.draw for r in drawn.select("draw").orderBy("draw").limit(p.sample_rows).collect()]  # numbers alone: each task sends as many
    texts = [r.text for r in drawn.filter(F.col("draw") <= first[-1]).orderBy("draw", "text").limit(p.sample_rows).collect()] if first else []
    return fit(texts, p)


def all_spans(text: str, field: Field) -> tuple[list, list]:
    """The base spans, and all spans: those of the field that meet no base span are added."""
    base = base_spans(text)
    added = [("crf", a, b) for a, b in field.spans(text) if not any(a < y and x < b for _, x, y in base)]
    return base, sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0])))


def scan(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end, code points, end exclusive).

    Null texts count as empty: no spans, the hash of nothing. Rows that repeat are scanned each; null doc_ids stay null.
    Other columns of docs are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, p).w)

    def fn():
        field = Field(p)
        field.w = shared.value
        field.freeze()

        def one(text: str | None):
            base, spans = all_spans(text or "", field)
            counts = [sum(k == kind for k, _, _ in base) for kind in KINDS[:3]]
            return (*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans))

        def each(batch: pd.DataFrame) -> pd.DataFrame:
            out = pd.DataFrame([one(t) for t in batch["text"]], columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy(dtype=object))
            return out

        return each

    return map_rows(docs.select("doc_id", "text"), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string", fn)


def masked(text: str, spans: list[tuple[str, int, int]], mask: str) -> str:
    out, at = [], 0
    for _, a, b in spans:
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame, mask: str = "[secret]", p: Params = Params()) -> DataFrame:
    """docs with every span replaced by the mask; n_chars, where docs has it, follows the new text. No row goes; nulls stay."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, p).w)
    schema = docs.schema

    def run(batches):
        forget()
        field = Field(p)
        field.w = shared.value
        field.freeze()
        for batch in batches:
            for some in slices(batch):
                texts = [t if t is None else masked(t, all_spans(t, field)[1], mask) for t in some.column("text").to_pylist()]
                at = some.schema.get_field_index("text")
                yield some.set_column(at, some.schema.field(at), pa.array(texts, some.schema.field(at).type))
        del field
        forget()

    out = docs.mapInArrow(run, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
