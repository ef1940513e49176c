"""The judge by keywords counts texts; it holds no list of a key's texts."""

from alinea.operators import rules


def test_keyword_judge_counts(spark):
    rows = [(1, "bad"), (1, "bad"), (1, "fine"), (1, "so so"), (2, "so so"), (2, "fine"), (3, "fine"), (3, None), (None, "bad")]
    out = rules.keyword_judge(spark.createDataFrame(rows, "k long, text string"), ["k"], "text", ["bad"], ["so so"])
    assert {r.k: tuple(r)[1:] for r in out.collect()} == {1: ("Red", 0.5, 4), 2: ("Amber", 0.5, 2), 3: ("Green", 1.0, 2), None: ("Red", 1.0, 1)}
    assert "collect_list" not in out._jdf.queryExecution().toString()
