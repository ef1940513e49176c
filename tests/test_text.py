"""Folds and keys against plain Python on small inputs."""

import os
import random
import re

import pyspark
import pytest
from pyspark.sql import functions as F

from alinea.functions import text as X
from alinea.operators import candidates, chunk, classify, docmap


def column(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.x for r in df.select("i", make(F.col("t")).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize("given,want", [("Article 1: Definitions", "definitions"), ("Section 12.1.2 - Indemnity", "indemnity"), ("1. Introduction", "introduction"), ("  CLAUSE 5.2 (a) --- TAXATION!!!  ", "taxation")])
def test_heading_norm(spark, given, want):
    assert column(spark, [given], X.heading_norm) == [want]


def plain_split(text, most):
    chunks, current = [], ""
    import re

    for p in [p.strip(" ") for p in re.split(r"\n\n+", text)]:
        if not p:
            continue
        if len(current) + len(p) <= most:
            current = p if not current else current + "\n\n" + p
            continue
        if current:
            chunks.append(current)
        if len(p) <= most:
            current = p
        else:
            cut = [p[i : i + most] for i in range(0, len(p), most)]
            chunks += cut[:-1]
            current = cut[-1]
    return chunks + ([current] if current else [])


def test_split_text(spark):
    rng = random.Random(1)
    texts = ["", "   ", "a" * 1000, "short"] + ["\n\n".join("x" * rng.randint(0, 90) for _ in range(rng.randint(0, 8))) for _ in range(60)]
    assert column(spark, texts, lambda c: chunk.split_text(c, 40)) == [plain_split(t, 40) for t in texts]


def test_chunk_text(spark):
    got = column(spark, ["", "  ", "a b c d e f g h i j", "a" * 1000], lambda c: chunk.chunk_text(c, 400))
    assert got[:3] == [[], [], ["a b c d e f g h i j"]]
    assert "".join(got[3]) == "a" * 1000 and len(got[3]) > 1 and len(got[3][0]) <= 500


def test_windows(spark):
    got = column(spark, ["x" * 6000, "", "y" * 2500], chunk.windows)
    assert [len(w) for w in got[0]] == [2500, 2500, 1500] and got[1] == [] and len(got[2]) == 1


def test_packed(spark):
    df = spark.createDataFrame([(["a" * 40, "b" * 40, "c" * 400, "d"],)], "x array<string>")
    assert [len(b) for b in df.select(chunk.packed(F.col("x"), 20).alias("p")).first().p] == [2, 1, 1]


@pytest.mark.parametrize("similarity,want", [(0.92, "Variation"), (0.99, "Matched"), (0.5, "Not Matched")])
def test_bands(spark, similarity, want):
    assert spark.range(1).select(classify.fast_status(F.lit(similarity)).alias("s")).first().s == want


def test_ambiguous_is_custom(spark):
    s = spark.createDataFrame([(0.9, 0.89), (0.9, 0.8), (0.99, 0.985), (0.6, None)], "a double, b double").select(classify.match_status(F.col("a"), F.col("b")).alias("s"))
    assert [r.s for r in s.collect()] == ["Custom", "Variation", "Matched", "Custom"]


def test_sections(spark):
    text = "before\n\nARTICLE 1 DEFINITIONS\n\nfirst words here\n\nmore words\n\nSection 2. Scope\n\nlast words"
    rows = docmap.heuristic_sections(spark.createDataFrame([(1, text)], "d long, t string"), "d", "t").orderBy("section").collect()
    assert [(r.heading, r.n_paragraphs) for r in rows] == [("Introduction", 1), ("ARTICLE 1 DEFINITIONS", 2), ("Section 2. Scope", 1)]


def test_near_duplicates(spark):
    base = "the insurer pays all sums due under this cover within thirty days of a claim being agreed "
    rows = [(1, "k", 1, base + "today"), (1, "k", 2, base), (1, "k", 3, base[:50] + " something else altogether that goes on for long enough to differ"), (1, "k", 4, None)]
    kept = candidates.without_near_duplicates(spark.createDataFrame(rows, "d long, k string, o long, b string"), "d", "k", "o", "b")
    assert [r.o for r in kept.orderBy("o").collect()] == [1, 3]


def test_near_duplicates_of_many_names_in_few_calls(spark, monkeypatch):
    """Against the fold by the book; all names of a task in one call, not a call for each."""
    rng, signs = random.Random(5), "abc "
    whole = ["".join(rng.choice(signs) for _ in range(200)) for _ in range(4)]

    def part():
        w = rng.choice(whole)
        return w[: rng.randint(0, 200)] if rng.random() < 0.5 else w[rng.randint(0, 90) :] + rng.choice(["", "x" * rng.randint(1, 30)])

    rows = [(d, rng.choice([None, "k", "l"]), o, rng.choice([None, part().upper(), part()])) for d in range(300) for o in range(6)]

    def by_the_book(some):
        bodies = [re.sub("[^a-z0-9]", "", (b or "").lower()) for *_, b in some]
        kept = []
        for i in sorted(range(len(some)), key=lambda k: (-len(bodies[k]), some[k][2])):
            own = bodies[i]
            near = any(own in bodies[k] or len(os.path.commonprefix([own, bodies[k]])) >= max(1, 0.92 * len(own)) for k in kept)
            if not kept or (len(own) >= 60 and not near):
                kept.append(i)
        return [some[k][:3] for k in kept]

    monkeypatch.setattr(pyspark.sql.GroupedData, "applyInPandas", None)
    groups = {}
    for r in rows:
        groups.setdefault(r[:2], []).append(r)
    want = {r for some in groups.values() for r in by_the_book(some)}
    got = candidates.without_near_duplicates(spark.createDataFrame(rows, "d long, k string, o long, b string"), "d", "k", "o", "b").collect()
    assert {(r.d, r.k, r.o) for r in got} == want and len(got) == len(want) < len(rows)


def test_page_quality(spark):
    good = "This page has a clean text layer with enough words to pass the test of length."
    assert column(spark, [good, "tiny", good + " andWales theReinsurer ofClaims forCover", None], X.is_dirty_page) == [False, True, True, True]
