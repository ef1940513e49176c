"""The stages on rows with nulls, empty texts, repeats and clashing columns, and the whole pipeline on the smallest tables."""

import os

import pytest
from test_operators import ODD, docs_of

import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")
def test_run(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.toPandas(), docs.schema)
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert last.count() == sizes[-1] and last.filter("not round_trip").count() == 0
    assert corpus_pipeline.run(spark, FOLDER).count() == sizes[-1]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_on_odd_rows(spark, name, tmp_path):
    """Rows of null ids, null and empty texts and repeats, with columns of names that operators use inside."""
    spark.createDataFrame([(1, 0), (6, None)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = docs_of(spark, ODD)
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    got, want = sorted(str((r.doc_id, r.text)) for r in out.collect()), sorted(str(x) for x in ODD)
    if name in ("toxicity", "secrets"):
        assert got == want
    elif name == "ngram_jaccard":
        assert got == sorted(str(x) for x in [*dict.fromkeys(x for x in ODD if x[0] is not None), *[x for x in ODD if x[0] is None]])
    else:
        assert set(got) <= set(want)
