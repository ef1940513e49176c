"""The forest's recall and the leaves of a vector do not depend on the dimension."""

import numpy as np
import pytest

from alinea.llm import forest


@pytest.mark.parametrize("dim", [8, 64, 768])
def test_recall_and_leaves(dim):
    rng, p = np.random.default_rng(dim), forest.Params()
    x = forest.units(rng.normal(size=(4000, dim)))
    off = rng.normal(size=(400, dim))
    off -= (off * x[:400]).sum(1, keepdims=True) * x[:400]
    near = 0.9801 * x[:400] + np.sqrt(1 - 0.9801**2) * forest.units(off)  # just linked
    trees = forest.Forest(x[:2048], dim, 16, p)
    own, other = trees.leaves(x[:400]), trees.leaves(near)
    assert np.mean([bool(set(a) & set(b)) for a, b in zip(own, other, strict=True)]) >= 0.99
    assert np.mean([len(a) for a in own]) < 45
