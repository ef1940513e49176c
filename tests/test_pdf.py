"""Intake of documents: files in a folder and requests of all kinds, bad and over-long ones reported; pages by a plugged reader."""

import base64
import json

from alinea.sources import pdf

PDF = b"%PDF-1.4\n"


def test_files_and_pages(spark, tmp_path):
    for name, content in {"a.pdf": PDF + "one\ftwo é".encode(), "sub/b.pdf": PDF + b"x" * 200, "c.pdf": b"no pdf", "e.pdf": PDF + b"\xff\xfe"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    found = pdf.files(spark, str(tmp_path), most=100)
    got = sorted((r.path.rsplit("/", 1)[1], r.page, r.text, r.problem) for r in pdf.pages(found, "path", pdf.plain_pages).collect())
    assert got == [("a.pdf", 1, "one", None), ("a.pdf", 2, "two é", None), ("b.pdf", None, None, "too large"), ("c.pdf", None, None, "not a PDF"), ("e.pdf", None, None, "reader: UnicodeDecodeError")]
    assert [r.problem for r in pdf.pages(found.filter("path like '%a.pdf'"), "path", lambda content: []).collect()] == ["no pages"]


def test_requests(spark):
    body = lambda **x: json.dumps(x).encode()
    code = lambda x: base64.b64encode(x).decode()
    requests = [
        (1, body(pdf_base64=code(PDF + b"one"))), (2, body(storage_path="in/2")), (3, body(storage_path="lost")), (4, body(pdf_url="https://example.com/x.pdf")), (5, PDF + b"raw \xff"), (6, b""), (7, None),
        (8, body(pdf_base64="$$$")), (9, body(pdf_base64=code(b"text"))), (10, b"not json"), (11, body(pdf_base64=code(PDF + b"x" * 500))), (12, body(storage_path="in/2", pdf_base64=code(PDF + b"other"))), (13, body(storage_path="in/13")), (14, b"{}"),
    ]
    stored = spark.createDataFrame([("in/2", PDF + b"stored", None), ("in/13", None, "too large")], "path string, content binary, problem string")
    got = {r.id: (r.content and bytes(r.content), r.problem) for r in pdf.requested(spark.createDataFrame(requests, "id int, body binary"), "id", "body", stored, most=300).collect()}
    want = {
        1: (PDF + b"one", None), 2: (PDF + b"stored", None), 3: (None, "no such file"), 4: (None, "no fetching of addresses"), 5: (PDF + b"raw \xff", None), 6: (None, "empty"), 7: (None, "empty"),
        8: (None, "not a PDF"), 9: (None, "not a PDF"), 10: (None, "not a PDF"), 11: (None, "too large"), 12: (PDF + b"stored", None), 13: (None, "too large"), 14: (None, "not a PDF"),
    }
    assert got == {k: (v[0], v[1]) for k, v in want.items()}
