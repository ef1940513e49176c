"""Whole results against plain versions of the methods, and every operator and stage on empty tables."""

import base64
import random

import numpy as np
import pytest
from test_operators import docs_of

import corpus_pipeline
from alinea.llm import edits, forest, jaccard, langid, minhash, mixing, secrets, suffixes, toxicity


def plain_sketch(tokens, p):
    """One value for each bin: the smallest hash's low bits; an empty bin asks the bins that its draws name, turn by turn."""
    least = {}
    for t in tokens:
        b = int(t) * p.bins >> 63
        least[b] = min(least.get(b, 1 << 63), int(t))
    out = []
    for b in range(p.bins):
        turn, at = 0, b
        while at not in least:
            at = next((int(d) for d in minhash.donors(p.bins, p.seed, turn)[b] if int(d) in least), at)
            turn += 1
        out.append(least[at] % (1 << p.bits))
    return out


def plain_likeness(a, b, p):
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    same = sum(x == y for x, y in zip(plain_sketch(a, p), plain_sketch(b, p), strict=True)) / p.bins
    chance = 1 / (1 << p.bits)
    return min(1.0, max(0.0, (same - chance) / (1 - chance)))


def test_fingerprints_columns(spark):
    rng, p = random.Random(3), minhash.Params()
    rows = [(i * 7, " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 9)) for _ in range(n))) for i, n in enumerate([0, 1, 4, 5, 9, 40, 300, 300])]
    rows.append((100, rows[-1][1]))
    got = {r.doc_id: r for r in minhash.fingerprints(docs_of(spark, rows)).collect()}
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        edited = text[: len(text) - len(text) // 4] + after[: len(text) // 4]
        own, other, following = (jaccard.shingles(t, p.words) for t in (text, edited, after))
        assert list(base64.b64decode(got[i].fingerprint)) == (plain_sketch(own, p) if len(own) else [])
        assert list(base64.b64decode(got[i].edited_fingerprint)) == (plain_sketch(other, p) if len(other) else [])
        assert got[i].near_edited == pytest.approx(plain_likeness(own, other, p))
        assert got[i].near_next == pytest.approx(plain_likeness(own, following, p))
    assert got[100].fingerprint == got[49].fingerprint and got[49].near_next == 1.0


def test_forest_components_and_kept(spark):
    """Chains of links: component_id and kept are those of all pairs compared one by one."""
    rng = np.random.default_rng(11)
    rows = []
    for k in range(12):  # each chain turns by about 8 degrees a step, so that only neighbours are linked
        a, b = np.linalg.qr(rng.normal(size=(16, 2)))[0].T
        rows += [(k + 12 * s, [float(x) for x in np.cos(0.14 * s) * a + np.sin(0.14 * s) * b], "x" if k % 4 else None) for s in range(10)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = {r.vec_id: r for r in forest.near_duplicates(df, forest.Params(leaf=64)).collect()}
    top = {i: i for i, _, _ in rows}
    links = dict.fromkeys(top, 0)

    def first(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, v, label in rows:
        for j, w, other in rows:
            if i < j and label is not None and label == other and np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98:
                links[i] += 1
                links[j] += 1
                a, b = first(i), first(j)
                top[max(a, b)] = min(a, b)
    assert max(links.values()) >= 2
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {i: (links[i], first(i), first(i) == i) for i in top}


def plain_toxicity(text, model, p):
    folded, start = model
    words, means = toxicity.words_of(text, p), []
    for at in range(0, max(1, len(words) - p.window + p.stride), p.stride):
        bag = [g for w in words[at : at + p.window] for g in toxicity.grams(w, p)]
        means.append(sum(folded[g] for g in bag) / (len(bag) + p.prior))
    return 1 / (1 + np.exp(-np.clip(max(means) + start, -30, 30)))


def test_toxicity_scores(spark):
    rng, p = random.Random(5), toxicity.Params(rounds=3)
    plain, bad = [f"word{k}" for k in range(60)], ["blorg", "fnarg", "skrull"]
    rows = []
    for i in range(120):
        words = [rng.choice(plain) for _ in range(rng.choice([5, 30, 90]))]
        if i % 3 == 0:
            words += [rng.choice(bad) for _ in range(4)]
        rows.append((i, " ".join(words)))
    rows += [(500, None), (501, ""), (502, "x" * 3000)]
    docs = docs_of(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, p)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels, p).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        want = plain_toxicity(text, model, p)
        assert got[i].score == pytest.approx(want, abs=1e-9) and got[i].predicted == int(got[i].score >= 0.5)


OPERATORS = {
    "toxicity": lambda d, spark: toxicity.toxicity(d, spark.createDataFrame([], "doc_id long, toxic int")),
    "suffixes": lambda d, spark: suffixes.dedup(d),
    "edits": lambda d, spark: edits.count_edits(edits.sample_edits(d)),
    "secrets": lambda d, spark: secrets.scan(d),
    "mixing": lambda d, spark: mixing.mix(d),
    "langid": lambda d, spark: langid.identify(d),
    "jaccard": lambda d, spark: jaccard.jaccard_components(d),
    "keep_first": lambda d, spark: jaccard.keep_first(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_tables(spark, name):
    assert OPERATORS[name](docs_of(spark, []), spark).count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_empty_tables(spark, name, tmp_path):
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert dict(corpus_pipeline.STAGES)[name](spark, docs_of(spark, []), str(tmp_path)).count() == 0
