"""Items of a library are found in texts whatever the library's size, broadcast or in shares alike."""

import random

import pytest

from alinea.operators import patterns, rules

TEXTS = [(1, "one two three, one two four"), (2, ""), (3, None), (4, "é漢😀 one two four é漢😀"), (4, "one two"), (None, "two four"), (5, "x" * 300 + "end"), (6, "aab"), (2**60 + 1, "two")]
ITEMS = [(1, "one two four"), (1, "one two four"), (2, "one two five"), (3, "two"), (4, ""), (5, None), (6, "x" * 200 + "end"), (7, "x" * 200 + "other"), (8, "😀"), (9, "ab")]


@pytest.mark.parametrize("limits", [{}, {"most": 0}, {"most_chars": 1, "spread": 2}, {"most": 2, "spread": 1}])
def test_found_items(spark, limits):
    got = patterns.found_items(spark.createDataFrame(TEXTS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, part string"), "doc_id", "text", "part", **limits)
    want = [(d, i, t.find(p) + 1) for d, t in TEXTS for i, p in ITEMS if t is not None and p is not None and p in t]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))


def test_all_words_of_modules_count(spark):
    modules = spark.createDataFrame([("first", 0, [f"word{k:04}" for k in range(1500)]), ("second", 1, ["Steel"])], "module string, place int, words array<string>")
    named = spark.createDataFrame([(1, "a word1499", None, None), (2, "steel", None, None), (3, "none", None, None)], "rule_id long, name string, category string, module_key string")
    got = {r.rule_id: r.module for r in rules.module_of(named, modules, "general").collect()}
    assert got == {1: "first", 2: "second", 3: "general"}


def test_random_texts(spark):
    """Equal to looking for each part in each text, for parts that are one another's ends, starts and middles."""
    rng = random.Random(4)
    texts = [(i, "".join(rng.choice("ab é") for _ in range(rng.randint(0, 40)))) for i in range(120)]
    parts = [(i, "".join(rng.choice("ab é") for _ in range(rng.randint(0, 5)))) for i in range(60)]
    docs, items = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(parts, "item_id long, part string")
    want = sorted((d, i, t.find(p) + 1) for d, t in texts for i, p in parts if p in t)
    for bounds in ({}, {"most": 7, "spread": 3}):
        out = patterns.found_items(docs, items, "doc_id", "text", "part", **bounds)
        assert sorted(map(tuple, out.collect())) == want
        assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    assert patterns.found_items(docs, items.limit(0), "doc_id", "text", "part").count() == 0


def nodes(plan):
    kind = plan.getClass().getSimpleName()
    inner = [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else []
    below = inner or [plan.children().apply(k) for k in range(plan.children().size())]
    return [plan, *(x for p in below for x in nodes(p))]


def test_texts_are_dealt_out_once(spark):
    """However many shares a library makes, no text is copied for each of them."""
    docs = spark.createDataFrame([(i, f"text {i} of many") for i in range(400)], "id long, t string")
    found = patterns.found_parts(docs, spark.createDataFrame([(f"text {i} ",) for i in range(0, 400, 7)], "part string"), "id", "t", most=1, spread=2)
    assert sorted(tuple(r) for r in found.collect()) == [(i, f"text {i} ", 1) for i in range(0, 400, 7)]
    written = [x.metrics().apply("shuffleRecordsWritten").value() for x in nodes(found._jdf.queryExecution().executedPlan()) if x.getClass().getSimpleName() == "ShuffleExchangeExec"]
    assert 400 <= sum(written) <= 400 + 4 * 58


@pytest.mark.parametrize("parts_most,chars_most", [(1, 10**6), (7, 10**6), (100, 6), (100, 1)])
def test_libraries_of_many_automata(spark, monkeypatch, parts_most, chars_most):
    monkeypatch.setattr(patterns, "SHARE_PARTS", parts_most)
    monkeypatch.setattr(patterns, "SHARE_CHARS", chars_most)
    rng = random.Random(5)
    texts = [(i % 50, "".join(rng.choice("ab") for _ in range(rng.randint(0, 6)))) for i in range(200)] + [(None, "ab")] * 3
    parts = [(i, "".join(rng.choice("ab") for _ in range(rng.randint(0, 4)))) for i in range(60)]
    out = patterns.found_items(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(parts, "item_id long, part string"), "doc_id", "text", "part", most=2, spread=3)
    want = [(d, i, t.find(p) + 1) for d, t in texts for i, p in parts if p in t]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
