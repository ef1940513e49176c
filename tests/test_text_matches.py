"""Text matching against a plain version: several blocks, one word in every text, copies, ties, empty and null texts."""

import random
from collections import Counter
from math import sqrt

import pytest

from alinea.operators import similarity


def cosine(a, b):
    x, y = Counter(a.split()), Counter(b.split())
    shared = sum(n * y[t] for t, n in x.items())
    return shared / (sqrt(sum(n * n for n in x.values())) * sqrt(sum(n * n for n in y.values()))) if shared else 0.0


def plain(queries, library, k, least=8):
    out = set()
    for q, text in queries:
        equal = sorted(i for i, t in library if t and t == text)
        near = [(-round(cosine(text, t), 9), i) for i, t in library if text and t and len(text) >= least and cosine(text, t) > 1 - 0.6]
        best = [(i, 1.0) for i in equal] if equal else [(i, -s) for s, i in sorted(near)]
        out |= {(q, i, round(s, 6), rank) for rank, (i, s) in enumerate(best[:k], 1)}
    return out


@pytest.mark.parametrize("block,cells", [(1000, 1 << 21), (5, 1 << 21), (7, 40)])
def test_matched_texts(spark, monkeypatch, block, cells):
    monkeypatch.setattr(similarity, "CELLS", cells)
    rng = random.Random(block)
    text = lambda: " ".join(["the"] * rng.randint(1, 3) + rng.choices("one two six ten red sea".split(), k=rng.randint(1, 6)))
    library = [(i, text()) for i in range(40)] + [(40, ""), (41, "solo"), (42, "the the the")]
    queries = [(i, text()) for i in range(60)] + [(60, ""), (61, None), (62, "solo"), (63, "the"), (64, "nothing shared"), (65, library[3][1])]
    df = lambda rows, name: spark.createDataFrame(rows, f"{name} long, text string")
    got = similarity.matched_texts(df(queries, "q"), df(library, "l"), "q", "l", 2, block=block).collect()
    assert {(r.q, r.l, round(r.similarity, 6), r["rank"]) for r in got} == plain([(q, t or "") for q, t in queries], library, 2)


def test_empty_tables(spark):
    none, one = spark.createDataFrame([], "id long, text string"), spark.createDataFrame([(1, "some text of some length")], "id long, text string")
    for a, b in ((none, one), (one, none), (none, none)):
        assert similarity.matched_texts(a.withColumnRenamed("id", "q"), b.withColumnRenamed("id", "l"), "q", "l").count() == 0
