"""The field of the secret scan: its likelihood by enumeration, and what it finds where nobody has marked the secrets of a corpus."""

import itertools
import random
import string
import uuid

import numpy as np
import pytest

from alinea.llm import secrets

ALL = string.ascii_letters + string.digits


def test_expected_states_by_enumeration():
    """Probabilities of states and steps are those of all paths written out, also where some states are known."""
    rng = np.random.default_rng(2)
    score, step = rng.normal(size=(3, 5, 3)), rng.normal(size=(3, 3))
    known = np.where(rng.random((3, 5, 1)) < 0.5, 0.0, np.where(np.eye(3)[rng.integers(0, 3, (3, 5))] > 0, 0.0, -np.inf))
    for given in (np.zeros_like(score), known):
        seen, pairs = secrets.expected(score + given, step)
        want, want_pairs = np.zeros_like(score), np.zeros((3, 3))
        for k in range(3):
            paths = list(itertools.product(range(3), repeat=5))
            weight = np.exp([sum(score[k, t, s] + given[k, t, s] for t, s in enumerate(p)) + sum(step[a, b] for a, b in zip(p, p[1:], strict=False)) for p in paths])
            for p, w in zip(paths, weight / weight.sum(), strict=True):
                for t, s in enumerate(p):
                    want[k, t, s] += w
                for a, b in zip(p, p[1:], strict=False):
                    want_pairs[a, b] += w
        assert np.allclose(seen, want) and np.allclose(pairs, want_pairs)


def texts_of(rng, n):
    syllables = [a + b for a in "bcdfghlmnprst" for b in ("a", "en", "io", "ur")]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    return [" ".join([word() for _ in range(rng.randint(40, 160))] + ([f"password = {''.join(rng.choice(ALL) for _ in range(24))}"] if k % 10 == 0 else [])) for k in range(n)]


@pytest.mark.parametrize("share", [0.0, 0.2])
def test_unmarked_secrets_are_not_unlearnt(share):
    """Keys that a fifth of the training texts hold without a mark are found all the same, and names, ids and paths are left alone."""
    rng = random.Random(6)
    some = lambda n, signs=ALL: "".join(rng.choice(signs) for _ in range(n))
    found = {"ghp": lambda: "ghp_" + some(36), "live": lambda: "sk_live_" + some(24)}
    harmless = {
        "uuid": lambda: str(uuid.UUID(int=rng.getrandbits(128))), "camel": lambda: "get" + rng.choice(["User", "Order"]) + rng.choice(["Name", "Index"]) + some(1, string.digits) + "Async",
        "iban": lambda: "DE" + some(20, string.digits), "path": lambda: f"/usr/lib/python3.{rng.randint(6, 13)}/site-packages/{some(7, string.ascii_lowercase)}.py",
    }

    def planted(text, value):
        words = text.split(" ")
        words.insert(rng.randrange(len(words) - 6), value)
        return " ".join(words)

    texts = [planted(t, rng.choice(list(found.values()))()) if rng.random() < share else t for t in texts_of(rng, 800)]
    field = secrets.fit(texts, secrets.Params())
    field.freeze()

    def hits(make):
        n = 0
        for text in texts_of(rng, 60):
            value = make()
            whole = planted(text, value)
            at = whole.index(value)
            n += any(k == "crf" and a < at + len(value) and b > at for k, a, b in secrets.all_spans(whole, field)[1])
        return n / 60

    assert min(hits(make) for make in found.values()) >= 0.9
    assert max(hits(make) for make in harmless.values()) <= 0.1  # of 60; from 800 texts alone
