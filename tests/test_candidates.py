"""Candidates of a document: its sections, then what it names as attached, then what it names by code."""

from alinea.operators import candidates, docmap

CONTRACT = """LIMITS CLAUSE

The limit is 5. It is told under the Interlocking Clause (As attached) and under the Loss Notice Clause (LSW 101). It is told in the Loss Notice Clause (LSW 102).

PERIOD NOTICE

It is told under the Limits Clause (as expiring), told in the Interlocking Clause (LSW 103).

It is told to the Broker Name (as attached). It is told in the Running Page Head (LSW 104). It is told in the Final Claims Clause (LSW 105).
""" + "\n\nRunning Page Head\n\nsome words" * 4


def test_references_of_both_kinds_in_order(spark):
    docs = spark.createDataFrame([(1, CONTRACT), (2, "It is told in words of the Limits Clause (as attached)"), (None, "LIMITS CLAUSE\n\nno key, told in the Limits Clause (as attached)")], "doc_id long, text string")
    running = docmap.running_headers(docs, "doc_id", "text")
    found = candidates.built(docmap.heuristic_sections(docs, "doc_id", "text"), "doc_id", running)
    attached, coded = candidates.attached_references(docs, "doc_id", "text"), candidates.coded_references(docs, "doc_id", "text")
    assert {(r.doc_id, r.name) for r in attached.collect()} >= {(1, "Limits Clause"), (1, "Broker Name")}
    assert {(r.name, r.code) for r in coded.collect()} == {("Loss Notice Clause", "LSW 101"), ("Loss Notice Clause", "LSW 102"), ("Interlocking Clause", "LSW 103"), ("Running Page Head", "LSW 104"), ("Final Claims Clause", "LSW 105")}
    rows = candidates.with_references(found, attached, coded, "doc_id", running).collect()
    assert {(r.doc_id, r.heading, r.code) for r in rows if r.body == ""} == {(1, "Interlocking Clause", None), (1, "Loss Notice Clause", "LSW 101"), (1, "Final Claims Clause", "LSW 105"), (2, "Limits Clause", None)}
    assert {(r.doc_id, r.heading) for r in rows if r.body} == {(1, "LIMITS CLAUSE"), (1, "PERIOD NOTICE"), (None, "LIMITS CLAUSE")}
    assert len(rows) == 7 and all(r.code is None for r in rows if r.body)
