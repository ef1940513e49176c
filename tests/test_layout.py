"""Maps of layouts and texts, outlines and breadcrumbs on texts that take every branch."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from alinea.functions import headings as H
from alinea.operators import layout


def layout_of(parts, pages=2, **more):
    """A layout in JSON: the parts a line each; a missing start is 0, offsets are strings as often as numbers."""
    text, at, found = "\n".join(parts), 0, []
    for k, part in enumerate(parts):
        segment = {"endIndex": at + len(part) if k % 2 else str(at + len(part))} | ({"startIndex": str(at)} if at else {})
        found.append({"layout": {"textAnchor": {"textSegments": [segment]}}})
        at += len(part) + 1
    size = -(-len(found) // pages)
    return json.dumps({"text": text, "pages": [{"paragraphs": found[k : k + size]} for k in range(0, len(found), size)], **more})


def maps(spark, *layouts):
    df = spark.createDataFrame(list(enumerate(layouts)), "doc_id long, layout string")
    out = {}
    for r in layout.layout_map(df, "doc_id", "layout").orderBy("doc_id", "section").collect():
        out.setdefault(r.doc_id, []).append((r.title, r.heading, r.number, r.paragraphs))
    return [out.get(k, []) for k in range(len(layouts))]


def test_layout_fixtures(spark):
    """Articles and sections; paragraphs below their heading; noise; numbered headings."""
    articles = ["ARTICLE 1", "This is the first article.", "SECTION 2.1", "This is a subsection.", "CLAUSE 3: Random Text."]
    below = ["ARTICLE 1", "Para 1.", "Para 2.", "ARTICLE 2", "Para 3."]
    noise = ["ARTICLE 1", "Some text here.", "Page 1 of 10", "ARTICLE 2", "More text.", "[OCR ERROR]", "775 BRE"]
    numbered = ["Section 1. Definitions", "These are the definitions.", "2.1 Payment Terms", "Pay within 30 days."]
    got = maps(spark, *map(layout_of, (articles, below, noise, numbered)))
    assert [x[1:3] for x in got[0]] == [("ARTICLE 1", "1"), ("SECTION 2.1", "2.1"), ("CLAUSE 3: Random Text.", "3")]
    assert [(x[1], x[3]) for x in got[1]] == [("ARTICLE 1", ["Para 1.", "Para 2."]), ("ARTICLE 2", ["Para 3."])]
    assert [(x[1], x[3]) for x in got[2]] == [("ARTICLE 1", ["Some text here."]), ("ARTICLE 2", ["More text."])]
    assert [(x[1], x[2], x[3]) for x in got[3]] == [("Section 1. Definitions", "1", ["These are the definitions."]), ("2.1 Payment Terms", "2.1", ["Pay within 30 days."])]
    assert {x[0] for g in got for x in g} == {"Document Map"}


def test_layout_labels_and_fallbacks(spark):
    labels = ["Some words before any heading.", "(a)", "(b)", "the second label counts", "ARTICLE 7", "c)", "a letter alone too", "(z)"]
    got = maps(spark, layout_of(labels), layout_of(["12", "Page 3", "....."]), '{"text": ""}', None, "no json", "{}", '{"text": "words alone"}', layout_of(["x"], pages=1) [:-1])
    assert [(x[1], x[2], x[3]) for x in got[0]] == [("General Provisions", None, ["Some words before any heading.", "(b) the second label counts"]), ("ARTICLE 7", "7", ["c) a letter alone too"])]
    assert got[1] == [("Initial Extraction Map", "Extracted Text", None, ["12\nPage 3\n....."])]
    assert all(g == [("Document Content", "Main Text", None, ["No text extracted."])] for g in got[2:6]) and got[6][0][1:] == ("Extracted Text", None, ["words alone"])


def test_layout_entities(spark):
    anchor = lambda at: {"textAnchor": {"textSegments": [{"startIndex": at}]}}
    entities = [
        {"type": "paragraph", "mentionText": "second  words", **anchor("30")}, {"type": "Section_Heading", "mentionText": "LIMITS", **anchor(20)}, {"type": "paragraph", "text": "opening words"},
        {"type": "title", "mentionText": "Page 4", **anchor(50)}, {"type": "page_header", "mentionText": "ALONE", **anchor(60)}, {"mentionText": "no type", **anchor(70)}, {"type": "x", "mentionText": None, **anchor(80)},
    ]
    (got,) = maps(spark, layout_of(["text"], entities=entities))
    assert [(x[1], x[2], x[3]) for x in got] == [("Introduction", None, ["opening words"]), ("LIMITS", None, ["second words"]), ("ALONE", None, ["no type"])]


NOISE = [
    "", " ", "7", "Page 3", "page 1 of 10", "3 of 7", "(c) 2020 all", "OCR error 5", "[ocr ERROR: x]", "775 BRE", "12.3 - 4", "-----", "x", "?!", "Confidential", "Registration No. X9", "Market  Reform Contract 7",
    "marketreformcontract", "see Registered Office: here", "the last page of it", "AB1 CD2 EF3", "Information Page",
]
WORDS = ["ARTICLE 1", "Pay within 30 days.", "1. Scope", "a b", "12345678901 is it, yes", "The registered office.", "775 BRENT", "Some text here.", "10-12-2020-10-12", "é"]


def flags(spark, f, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", f(F.col("t")).alias("v")).collect()
    return [r.v for r in sorted(rows)]


def test_noise_lines(spark):
    assert [t for t, v in zip(NOISE, flags(spark, H.is_noise_line, NOISE), strict=True) if not v] == []
    assert [t for t, v in zip(WORDS, flags(spark, H.is_noise_line, WORDS), strict=True) if v] == ["é"]


@pytest.mark.parametrize("f,yes,no", [
    (H.is_heading, ["ARTICLE 1", "Section iv terms", "1. Scope", "1.2.3 Scope", "LIMITS - A/B & C", "Part B"], ["12", "Article", "1.scope", "WE SHALL PAY", "Limits of it", "1. 2 Scope", "-AB", "A " * 13, "Clause " + "x" * 150]),
    (H.is_layout_heading, ["ARTICLE 1", "Premium: 5", "1.1 Scope", "LIMITS", "Type"], ["ABCDEFGH1", "the limits", "Premium and all that is due: 5", "Section 1 as referred to", "Article 3 if applicable", "123", "Section " + "x " * 21]),
    (H.is_orphan_label, ["(a)", "b)", " (1) ", "C)"], ["(ab)", "a", "()", "(a) x", "((a)"]),
    (H.is_protected_heading, ["ARTICLE 5 - PREMIUM", "Section IV", "annexure 1", "Interest (LSW 300)"], ["Article", "A section 5", "Notice"]),
    (H.is_label_heading, ["Client Name:", "previous ref.", "ref / contact", "USD 27,100,000.", "50%", "XIV", "1. Policies which cover", "(3) a b c d e f g", "UMR", "the long name", "Contract Document Date", "2. It is other than so"], ["1. Definitions", "Limits", "ARTICLE 1 which", "client", "eur notes"]),
])
def test_kinds_of_lines(spark, f, yes, no):
    assert [t for t, v in zip(yes, flags(spark, f, yes), strict=True) if not v] == []
    assert [t for t, v in zip(no, flags(spark, f, no), strict=True) if v] == []


def test_joined_heading(spark):
    cases = [
        ("LIMITS AND", "RETENTIONS: USD 5", "LIMITS AND RETENTIONS"), ("CLASS OF", "BUSINESS Interest here", "CLASS OF BUSINESS"), ("TAXES PAYABLE", "TAXES PAYABLE", "TAXES PAYABLE"),
        ("MODE OF", "ONE TWO THREE FOUR", "MODE OF ONE TWO THREE"), ("LIMITS AND", "lower words", "LIMITS AND"), ("LIMITS", "RETENTIONS: 5", "LIMITS"), ("Limits and", "RETENTIONS: 5", "Limits and"),
        ("LIMITS AND", "REINSURERtSf: x", "LIMITS AND"), ("LIMITS AND", None, "LIMITS AND"), ("A" * 40 + " AND", "B: x", "A" * 40 + " AND"), ("LIMITS AND", "ALPHA, BETA", "LIMITS AND ALPHA"), (None, "X: y", None),
    ]
    rows = spark.createDataFrame([(i, h, b) for i, (h, b, _) in enumerate(cases)], "i int, h string, b string").select("i", H.joined_heading(F.col("h"), F.col("b")).alias("v")).collect()
    assert [r.v for r in sorted(rows, key=lambda r: r.i)] == [c[2] for c in cases]


OUTLINE = "before\n\n1 One\n\nwords of one\n\n1.1 Two\n\nwords of two\n\n1.1.1 Three\n\nwords of three\n\n1.2 Four\n\nwords of four\n\n2 Five\n\nwords of five and more\n\nANNEX A\n\nwords of two"


def test_outline_and_breadcrumbs(spark):
    docs = spark.createDataFrame([(1, OUTLINE), (2, None), (3, "words alone"), (None, "1 One\n\nnull key")], "doc_id long, text string")
    tree = layout.outline(layout.heuristic_map(docs, "doc_id", "text"), "doc_id")
    got = [(r.section, r.depth, r.parent, r.last, r.path) for r in tree.filter("doc_id = 1").orderBy("section").collect()]
    assert got == [
        (0, 1, None, 0, "Introduction"), (1, 1, None, 4, "1 One"), (2, 2, 1, 3, "1 One > 1.1 Two"), (3, 3, 2, 3, "1 One > 1.1 Two > 1.1.1 Three"), (4, 2, 1, 4, "1 One > 1.2 Four"),
        (5, 1, None, 5, "2 Five"), (6, 1, None, 6, "ANNEX A"),
    ]
    evidence = spark.createDataFrame([(1, "of three"), (1, "words of two"), (1, "said: words of five and more, and so on"), (1, "nowhere"), (1, ""), (1, None), (3, "alone"), (9, "alone")], "doc_id long, e string")
    found = {(r.doc_id, r.e): (r.section, r.heading) for r in layout.breadcrumbs(evidence, tree, "doc_id", "e").collect()}
    assert found == {
        (1, "of three"): (3, "1.1.1 Three"), (1, "words of two"): (2, "1.1 Two"), (1, "said: words of five and more, and so on"): (5, "2 Five"), (1, "nowhere"): (None, None), (1, ""): (None, None),
        (1, None): (None, None), (3, "alone"): (0, "Introduction"), (9, "alone"): (None, None),
    }


def test_breadcrumbs_of_rows_in_any_order(spark):
    """Evidence that comes in another order each time it is read, as rows of several executors do."""

    def mixed(batches):
        for batch in batches:
            yield batch.take(random.SystemRandom().sample(range(batch.num_rows), batch.num_rows))

    docs = spark.createDataFrame([(d, "\n\n".join(f"{k} Scope\n\nwords of {k} in {d}." for k in range(1, 40))) for d in range(5)], "doc_id long, text string")
    rows = [(d, f"words of {k} in {d}.") for d in range(5) for k in range(1, 40)] + [(0, "words of 7 in 0."), (1, "nowhere")]
    evidence = spark.createDataFrame(rows, "doc_id long, e string").coalesce(1).mapInArrow(mixed, "doc_id long, e string")
    found = layout.breadcrumbs(evidence, layout.heuristic_map(docs, "doc_id", "text"), "doc_id", "e")
    assert found.columns == ["doc_id", "e", "section", "heading", "number"]
    want = [(d, e, *((int(e.split()[2]), f"{e.split()[2]} Scope", e.split()[2]) if e != "nowhere" else (None,) * 3)) for d, e in rows]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))


def test_long_layouts_take_their_share_of_time(spark):
    """Twenty thousand paragraphs in one layout are not much slower than in twenty; parts are cut where two pieces of the text meet as well."""
    parts = [f"é{k} " + "some words of it " * (k % 7) + "end." for k in range(20_000)]
    one, many = [layout_of(parts)], [layout_of(parts[k : k + 1000]) for k in range(0, 20_000, 1000)]

    def run(layouts):
        df = spark.createDataFrame(list(enumerate(layouts)), "doc_id long, layout string").coalesce(1)
        start = time.time()
        rows = layout.layout_map(df, "doc_id", "layout").select("doc_id", "paragraphs").collect()
        return time.time() - start, [p for r in sorted(rows) for p in r.paragraphs]

    run(many)
    (few_s, few), (long_s, long) = run(many), run(one)
    assert few == long == parts
    assert long_s < 5 * few_s + 2
