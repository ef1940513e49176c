"""Passages of over 50 words that documents share, by op4_suffix_dedup as it is registered: 400 bytes decide, not words."""

from __future__ import annotations

import hashlib
import random

import brute

from alinea.llm import registry


def test_passages_of_over_50_words(spark, tmp_path):
    rng = random.Random(12)
    said = lambda n, least, most: " ".join("".join(rng.choice("etaoinshré") for _ in range(rng.randint(least, most))) for _ in range(n))
    long = [said(n, 5, 9) for n in (51, 60, 75, 120, 192)]
    short = [said(n, 4, 6) for n in (51, 55)]  # over 50 words and under 400 bytes
    assert min(len(p.encode()) for p in long) >= 400 > max(len(p.encode()) for p in short) + 40
    rows, holds = [], {}
    for i in range(80):
        text, passage = [said(rng.randint(20, 120), 2, 9), said(rng.randint(1, 90), 2, 9)], None
        if i % 4 == 1:
            passage = long[i // 4 % 5]
        elif i % 4 == 2:
            passage = short[i // 4 % 2]
        elif i % 4 == 3:
            passage = long[i // 4 % 5].replace(" ", "\n" * (2 + i))  # the words alone repeat
        rows.append((i, " ".join(text if passage is None else [text[0], passage, text[1]])))
        holds[i] = passage
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in registry.op4_suffix_dedup(spark, str(tmp_path)).collect()}
    for i, text in rows:
        assert got[i].n_bytes == len(text.encode())  # of the whole text, whatever is removed
        if i % 4 == 1:
            assert len(holds[i].encode()) <= got[i].n_removed <= len(holds[i].encode()) + 12 and got[i].removed
        else:
            assert got[i].n_removed == 0 and not got[i].removed
    want = brute.repeated_bytes([(i, t.encode()) for i, t in rows], 400)
    assert sorted(tuple(r)[:5] for r in got.values()) == sorted((*r[:4], hashlib.sha256(r[4]).hexdigest()) for r in want)
