"""Edits between texts: shortest, complete, readable."""

import random
import time

import pytest

from alinea.functions import diff


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def applied(ops):
    return "".join(t for k, t in ops if k != diff.INSERTED), "".join(t for k, t in ops if k != diff.DELETED)


@pytest.mark.parametrize("signs", ["ab", "abcde", "é漢😀 x"])
def test_scripts_are_shortest(signs):
    rng = random.Random(len(signs))
    for _ in range(400):
        a, b = ("".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) for _ in range(2))
        ops = [(k, "".join(t)) for k, t in diff.script(a, b)]
        assert applied(ops) == (a, b)
        assert sum(len(t) for k, t in ops if k != diff.KEPT) == len(a) + len(b) - 2 * longest_common(a, b)
        assert applied(diff.edits(a, b)) == (a, b)


def test_known_scripts():
    assert diff.edits("the cat sat", "the bat sat") == [("equal", "the "), ("delete", "c"), ("insert", "b"), ("equal", "at sat")]
    assert diff.edits("", "") == [] and diff.edits(None, "ab") == [("insert", "ab")] and diff.edits("ab", None) == [("delete", "ab")] and diff.edits("ab", "ab") == [("equal", "ab")]
    assert diff.edits("mouse", "sofas") == [("delete", "mouse"), ("insert", "sofas")]  # o and s are kept by chance only
    assert diff.edits("within 30 days", "within 45 days") == [("equal", "within "), ("delete", "30"), ("insert", "45"), ("equal", " days")]


def test_long_texts():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(6000)]
    other = list(words)
    for k in range(0, 6000, 500):
        other[k] = "changed"
    del other[3000:3005]
    a, b = " ".join(words), " ".join(other)
    ops = diff.edits(a, b)
    assert applied(ops) == (a, b) and sum(len(t) for k, t in ops if k == diff.KEPT) > 0.98 * len(a)
    assert applied(diff.edits(a, "x" * 5000)) == (a, "x" * 5000)


@pytest.mark.parametrize("cells,near", [(1 << 24, 256), (30, 256), (30, 0), (1, 3)])
def test_every_way_gives_shortest_scripts(monkeypatch, cells, near):
    monkeypatch.setattr(diff, "CELLS", cells)
    monkeypatch.setattr(diff, "NEAR", near)
    rng = random.Random(cells + near)
    for _ in range(200):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randint(0, 40))) for _ in range(2))
        ops = [(k, "".join(t)) for k, t in diff.script(a, b)]
        assert applied(ops) == (a, b)
        assert sum(len(t) for k, t in ops if k != diff.KEPT) == len(a) + len(b) - 2 * longest_common(a, b)


def test_unlike_texts_are_compared_in_a_few_milliseconds():
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(300)) for _ in range(41)]
    start = time.process_time()
    for a, b in zip(texts, texts[1:], strict=False):
        assert applied(diff.edits(a, b)) == (a, b)
    assert time.process_time() - start < 1  # 40 pairs
