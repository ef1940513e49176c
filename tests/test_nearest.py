"""The best items by vector, whichever side is told to tasks, against all pairs one by one."""

import numpy as np
import pytest

from alinea.operators import nearest

ROW = "id long, vec array<float>, label string"


def rows_of(rng, n, first):
    base = rng.normal(size=(6, 8))
    out = [(first + i, [float(x) for x in np.float32(base[i % 6] + (rng.normal(size=8) * 0.4 if i % 3 else 0))], ["a", "b", None][i % 3]) for i in range(n)]
    return [*out, (first + n, [0.0] * 8, "a"), (first + n + 1, None, "a"), (None, out[0][1], "a")]


def plain(queries, items, k, least, kind, from_boosted):
    found = []
    for q, v, a in queries:
        hits = []
        for i, w, b in items:
            if q is None or i is None or v is None or w is None or q == i:
                continue
            v_, w_ = np.array(v), np.array(w)
            s = float(v_ @ w_ / max(np.linalg.norm(v_), 1e-300) / max(np.linalg.norm(w_), 1e-300))
            same = a is not None and a == b
            out = (s if same else -9) if kind == "same" else min(1.0, s * 1.1) if kind == "boosted" and same else s
            if s > least and out >= max(from_boosted, -8):
                hits.append((-round(out, 9), i))
        found += [(q, i, r + 1, -s) for r, (s, i) in enumerate(sorted(hits)[:k])]
    return sorted(found)


@pytest.mark.parametrize("most_bytes", [nearest.HELD_BYTES, 4000, 100], ids=["queries", "library", "blocks"])
@pytest.mark.parametrize("kind,least,from_boosted,k", [("any", -2.0, -8.0, 3), ("same", 0.2, -8.0, 2), ("boosted", 0.3, 0.7, 5), ("any", 0.4, -8.0, 1000)])
def test_vector_top_k(spark, monkeypatch, most_bytes, kind, least, from_boosted, k):
    rng = np.random.default_rng(k)
    queries, items = rows_of(rng, 90, 0), rows_of(rng, 40, 40)
    if most_bytes == nearest.HELD_BYTES:
        monkeypatch.setattr(nearest, "CELLS", 64)
    a = spark.createDataFrame(queries, ROW).selectExpr("id q", "vec v", "label")
    b = spark.createDataFrame(items, ROW).selectExpr("id item", "vec w", "label").repartition(3)
    got = nearest.vector_top_k(a, b, k, least, kind, from_boosted, most_bytes=most_bytes, block=16).collect()
    want = plain(queries, items, k, least, kind, from_boosted)
    assert sorted((r.q, r.item, r["rank"]) for r in got) == [w[:3] for w in want] and want
    assert np.allclose([s for *_, s in sorted((r.q, r.item, r["rank"], r.similarity) for r in got)], [w[3] for w in want])


@pytest.mark.parametrize("most_bytes", [nearest.HELD_BYTES, 4000, 100])
def test_vector_counts(spark, most_bytes):
    rng = np.random.default_rng(1)
    queries, items = rows_of(rng, 90, 0), rows_of(rng, 40, 40)
    a, b = spark.createDataFrame(queries, ROW).selectExpr("id q", "vec v"), spark.createDataFrame(items, ROW).selectExpr("id item", "vec w").repartition(3)
    got = {r.q: (r.n, round(r.best, 6)) for r in nearest.vector_counts(a, b, 0.9, most_bytes=most_bytes, block=16).collect()}
    want = {}
    for q, _, _, s in plain(queries, items, 10**6, -9.0, "any", 0.9):
        n, best = want.get(q, (0, -9.0))
        want[q] = n + 1, round(max(best, s), 6)
    assert got == want and want
    assert nearest.vector_counts(a.limit(0), b, 0.9).count() == nearest.vector_counts(a, b.limit(0), 0.9).count() == 0


@pytest.mark.parametrize("kind,least,from_boosted", [("any", -2.0, -8.0), ("same", 0.2, -8.0), ("boosted", 0.3, 0.7)])
@pytest.mark.parametrize("dense", [1, 10**9], ids=["pairs", "whole"])
def test_few_queries_are_told_and_products_are_exact(spark, monkeypatch, kind, least, from_boosted, dense):
    rng = np.random.default_rng(7)
    queries, items = rows_of(rng, 20, 0), rows_of(rng, 300, 10)
    monkeypatch.setattr(nearest, "DENSE", dense)
    a = spark.createDataFrame(queries, ROW).selectExpr("id q", "vec v", "label")
    b = spark.createDataFrame(items, ROW).selectExpr("id item", "vec w", "label")
    got = nearest.vector_top_k(a, b, 4, least, kind, from_boosted).collect()
    assert sorted((r.q, r.item, r["rank"]) for r in got) == [w[:3] for w in plain(queries, items, 4, least, kind, from_boosted)]


@pytest.mark.parametrize("most_bytes", [nearest.HELD_BYTES, 100], ids=["told", "blocks"])
def test_a_library_in_one_file_meets_its_queries_in_many_tasks(spark, most_bytes):
    rows = spark.createDataFrame(rows_of(np.random.default_rng(3), 400, 0), ROW).coalesce(1)
    found = nearest.met(nearest.side(rows, "id", "vec", "any"), nearest.side(rows, "id", "vec", "any"), nearest.Score("any", -2.0, -8.0), "q long, item long, similarity double", lambda ids: nearest.Best(ids, 3), most_bytes, 400)
    assert found.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).filter(lambda n: n > 0).count() > 4
