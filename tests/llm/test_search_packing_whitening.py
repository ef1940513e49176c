"""Packing, ranked search and whitening against plain versions, and on odd rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from test_operators import docs_of

from alinea.llm import lexical, packing, toxicity, whitening

TOKENIZER = P.path("byte_bpe_50k.json")
ITEM = "item_id long, text string, score int, rank string"


def plain_best_fit(counts, size=1024):
    """Best fit of falling lengths, piece by piece."""
    rooms = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fitting = [r for r in rooms if r >= length]
            room = min(fitting) if fitting else size
            if fitting:
                rooms.remove(room)
            rooms.append(room - length)
    return len(rooms)


@pytest.mark.parametrize("low,high", [(1, 1023), (200, 700), (330, 360), (1, 60), (513, 1023)])
def test_packed_holds_all_and_is_no_worse_than_best_fit(low, high):
    rng = random.Random(low)
    for n in (1, 7, 300, 1500):
        counts = Counter(rng.randint(low, high) for _ in range(n))
        kinds, got = packing.packed(counts), Counter()
        for kind in kinds:
            assert kind.count > 0 and sum(length * each for length, each in kind.parts) == 1024 - kind.room >= 0
            for length, each in kind.parts:
                got[length] += each * kind.count
        assert got == counts
        assert packing.sequences(kinds) <= plain_best_fit(counts)


def test_configurations_beat_best_fit():
    """Three of one length and two of another fill a sequence; best fit of falling lengths does not find it."""
    counts = {340: 300, 342: 300}  # 340 + 342 + 342 is 1024
    assert packing.sequences(packing.packed(counts)) == 200
    rng = random.Random(2)
    some = Counter(rng.randint(330, 360) for _ in range(2000))
    assert packing.sequences(packing.packed(some)) < plain_best_fit(some)


def test_linear_programme_by_hand():
    patterns = packing.configurations(np.array([600, 400]), np.array([10.0, 30.0]), packing.Params())
    assert sum(often for _, often in patterns) == pytest.approx(20)  # ten of 600 and 400, ten of twice 400
    assert packing.best_pattern(np.array([300, 500]), np.array([0.3, 0.6]), 1024)[1].tolist() == [0, 2]


def test_groups_have_equal_cardinality():
    counts = {k: 5 for k in range(200, 800)}
    groups = packing.grouped(counts, 30)
    sizes = [sum(c for _, c in g) for g in groups]
    assert sum(sizes) == 3000 and max(sizes) <= 105 and len(groups) >= 28
    assert [g[0][0] for g in groups] == sorted((g[0][0] for g in groups), reverse=True)


def test_encoder_is_exact():
    rng, plain = random.Random(4), packing.tokenizer(TOKENIZER)
    signs = ["a", "the ", "ing", " ", "  ", "\n", " \n", "é", "漢", "😀", "\x1c", "\x85", "1", "'ll", "'", "...", "ſ", "tion", "　", "\xa0", "<|endoftext|>"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(600)] + [""]
    few = packing.Encoder(TOKENIZER, most=100, batch=50)
    for at in range(0, len(texts), 40):
        for text, ids in zip(texts[at : at + 40], few.encode(texts[at : at + 40]), strict=True):
            assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids


def test_pack(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["alpha", "ünï", "x1", "the"]) for _ in range(rng.choice([0, 1, 30, 400, 900, 3000])))) for i in range(80)]
    rows += [(3, "again"), (3, "again"), (None, "no id"), (90, None), (91, ""), (92, "word " * 300_000), (93, "漢" * 50_000)]
    got = packing.pack(docs_of(spark, rows).repartition(3)).toPandas()
    plain = packing.tokenizer(TOKENIZER)
    want = Counter()
    for i, text in rows:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    key = [None if math.isnan(i) else int(i) for i in got["doc_id"].astype(float)]
    assert Counter(zip(key, got["piece"], got["start"], got["length"], got["ids_crc32"], strict=True)) == want
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own["offset"].tolist() == [0, *np.cumsum(own["length"]).tolist()][:-1] and own["length"].sum() <= 1024
    assert got["sequence_id"].nunique() == got["sequence_id"].max() + 1
    assert packing.pack(docs_of(spark, [])).count() == 0


def plain_search(docs, items, k):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bags = [(i, Counter(words(t))) for i, t in docs]
    n, total = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    out = []
    for item, text in items:
        found = []
        for i, b in bags:
            m = 50 + (50 * sum(b.values()) * n) // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * b[w]) // (1000 * b[w] + 20 * m)) for w in set(words(text)) if b[w])
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("p", [lexical.Params(k=3, shard=7, items=2, shares=3), lexical.Params(k=5, shard=16, terms=200), lexical.Params(k=1000)])
def test_search(spark, p):
    rng = random.Random(p.k)
    vocabulary = [f"w{int(rng.paretovariate(0.8))}" for _ in range(400)]
    docs = [(i * 3, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 5, 40, 200])))) for i in range(90)]
    docs += [(1000 + i, docs[5][1]) for i in range(9)] + [(7, None), (8, ""), (9, " .,- "), (3, "W1 w1 Äb ÄB w2"), (None, "w1 w2 w3"), (11, "w1-w1_w1\x00w2 " * 3000)]
    rng.shuffle(docs)
    items = [(k, " ".join(rng.sample(vocabulary, 12))) for k in range(6)] + [(6, None), (7, ""), (8, "?!"), (9, "äb"), (10, "nowhere"), (0, "w1"), (None, "w2 W1."), (12, "w1 " * 50_000)]
    got = lexical.rank_documents(docs_of(spark, docs).repartition(3), spark.createDataFrame([(*x, 1, "y") for x in items], ITEM), p)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_search(docs, items, p.k)


def test_search_opens_few_lists():
    """A rare term with a high bound settles the item: the common one is only probed."""
    lengths = np.full(4000, 10)
    lists = lexical.Lists(lengths, 4000, 40_000, lexical.Params())
    lists.put("common", 10, np.arange(4000), np.ones(4000, int), np.array([1]), np.array([10]))
    lists.put("rare", 9000, np.arange(60), np.ones(60, int), np.array([1]), np.array([10]))
    places, scores = lexical.best_of(["common", "rare"], lists, 50)
    assert "common" not in lists.opened and places.tolist() == list(range(60)) and len(set(scores.tolist())) == 1


def test_search_without_rows(spark):
    docs, items = docs_of(spark, [(1, "a b")]), spark.createDataFrame([(1, "a", 1, "y")], ITEM)
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs_of(spark, [(1, None)]), items)):
        assert lexical.rank_documents(d, i).count() == 0


VECTOR = "vec_id long, embedding array<float>, label int, component string, n string"


def plain_whitening(rows, most=32):
    kept = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    x = np.floor(64 * np.array([v for _, v in kept], "float32").astype(float)).astype("int64") + 1_000_000
    n, s = len(x), x.sum(0)
    off = n * x - s
    v = (off / n).T @ (off / n) / n
    e, u = np.linalg.eigh(v)
    return [i for i, _ in kept], n, (off**2).sum(1), off / n @ u[:, ::-1][:, :most] / np.sqrt(e[::-1][:most]), e[::-1][:most] / np.trace(v)


def test_whiten(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=6) * [9, 5, 4, 3, 2, 1] + 7]) for i in range(300)]
    rows += [(1, rows[1][1]), (400, None), (401, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (404, []), (405, [0.0] * 6)]
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], VECTOR).repartition(3)
    got = whitening.whiten(df).toPandas()
    ids, n, deviation, white, share = plain_whitening(rows)
    assert len(got) == 6 * len(ids) and set(got["n"]) == {n} and got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-9
    own = got[got["vec_id"] != 1].pivot(index="vec_id", columns="component", values="whitened")
    keep = [k for k, i in enumerate(ids) if i != 1]
    plain = white[keep] * np.sign((own.loc[[ids[k] for k in keep]].to_numpy() * white[keep]).sum(0))
    assert np.allclose(own.loc[[ids[k] for k in keep]].to_numpy(), plain, atol=1e-9)
    assert sorted(got[got["component"] == 1]["deviation"]) == sorted(deviation.tolist())
    assert np.allclose(got[got["vec_id"] == 5].sort_values("component")["explained"], share)
    assert (got["vec_id"] == 1).sum() == 12


def test_whiten_odd_tables(spark):
    make = lambda rows: spark.createDataFrame([(*r, 1, "x", "y") for r in rows], VECTOR)
    assert whitening.whiten(make([(1, None)])).count() == 0 and whitening.whiten(make([])).count() == 0
    same = whitening.whiten(make([(1, [0.5, 0.5]), (None, [0.5, 0.5])])).collect()
    assert len(same) == 4 and all(r.whitened == 0 and r.deviation == 0 and r.explained == 0 and r.identity_error == 0 for r in same)
    flat = whitening.whiten(make([(i, [float(i), 1.0]) for i in range(8)])).collect()
    assert {r.whitened for r in flat if r.component == 2} == {0.0} and sum(r.whitened**2 for r in flat if r.component == 1) == pytest.approx(8)
    two = whitening.whiten(make([(1, [0.0]), (2, [1.0]), (3, [0.0, 1.0]), (4, [1.0, 0.0])])).collect()
    assert sorted((r.vec_id, r.component, r.n) for r in two) == [(1, 1, 2), (2, 1, 2), (3, 1, 2), (3, 2, 2), (4, 1, 2), (4, 2, 2)]


def test_toxicity_learns_from_few_rows():
    """45 toxic rows with a few of ten words each among hundreds of others, as many clean rows as a small table has: most unseen ones are caught."""
    rng, bad = random.Random(8), ["blorg", "fnarg", "skrull", "zwimble", "krotch", "vlimp", "gnask", "prutz", "drelk", "womph"]
    syllables = [a + b for a in "bcdfghlmnprst" for b in ("a", "en", "io", "ur")]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))

    def text(toxic):
        words = [word() for _ in range(rng.choice([60, 150, 400]))]
        for _ in range(rng.randint(2, 4) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        return " ".join(words)

    p = toxicity.Params()
    labels = [1] * 45 + [0] * 280
    of = toxicity.log_odds(toxicity.fit([text(y) for y in labels], labels, p), p)
    caught, false = sum(of(text(1)) > 0 for _ in range(60)), sum(of(text(0)) > 0 for _ in range(200))
    assert caught >= 36 and false <= 4, (caught, false)
