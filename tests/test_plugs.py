"""Functions that SQL calls by name: chunks as the column expression gives them, plugs of the user's own."""

import random

import pandas as pd

from alinea.functions import plugs
from alinea.operators import chunk


def test_chunks_in_sql(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["word ", "x" * 30, "\n", "\n\n", "\n\n\n", " ", "é漢😀"]) for _ in range(rng.randint(0, 40))) for _ in range(200)] + [None, "", "y" * 95, "a\n\nb", " \n\n "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.createOrReplaceTempView("plug_docs")
    plugs.register(spark)
    got = spark.sql("SELECT d.doc_id, c.idx, c.chunk FROM plug_docs d, LATERAL chunks(d.text, 30) c").collect()
    want = chunk.exploded(docs, chunk.split_text(docs["text"], 30), "doc_id").collect()
    assert sorted((r.doc_id, r.idx, r.chunk) for r in got) == sorted((r.doc_id, r.idx, r.chunk) for r in want) and len(got) > 300


def test_plugs_by_name(spark):
    plugs.register(spark)
    (row,) = spark.sql("SELECT embed('Two words two') AS v, embed(NULL) AS z, judge('two words', 'words and two') AS a, judge('two words', 'one word of two') AS b, judge('x', NULL) AS c").collect()
    assert abs(sum(x * x for x in row.v) - 1) < 1e-6 and set(row.z) == {0.0}
    assert (row.a.status, row.b.status, row.c.status, row.b.confidence) == ("Green", "Amber", "Red", 0.5)
    plugs.register(spark, lambda texts: texts.map(lambda t: [float(len(t or ""))]), lambda rules, texts: pd.DataFrame({"status": rules, "confidence": 1.0, "reasoning": texts}))
    (row,) = spark.sql("SELECT embed('abc') AS v, judge('r', 't') AS j").collect()
    assert row.v == [3.0] and tuple(row.j) == ("r", 1.0, "t")
