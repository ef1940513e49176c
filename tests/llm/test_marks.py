"""What groups of the n-gram join are narrowed by: marks of the smallest tokens, and what of it is shuffled."""

from __future__ import annotations

import numpy as np
import pytest

from alinea.llm import jaccard

TOP = (1 << 63) - 1


@pytest.mark.parametrize("spread", [1 << 63, 1 << 50, 1 << 46])
def test_marks_share_no_less_than_tokens(spread):
    rng, limit = np.random.default_rng(5), int(0.3 * TOP)
    pool = np.unique(rng.integers(0, spread, 900))
    for _ in range(40):
        a, b = (np.sort(rng.choice(pool, rng.integers(0, 800), replace=False)) for _ in range(2))
        own, other = (jaccard.told_apart(jaccard.marks_of(x, limit)) for x in (a, b))
        known = [x[x < limit] for x in (a, b)]
        assert [len(own), len(other)] == [len(x) for x in known] and len(np.unique(own)) == len(own) and (np.diff(own) > 0).all()
        assert np.isin(own, other).sum() >= len(np.intersect1d(*known))
        least = -(-80 * (len(a) + len(b)) // 180)
        if len(np.intersect1d(a, b)) >= least:
            assert jaccard.may_link((len(a), own), (len(b), other), 80)
    assert len(jaccard.marks_of(np.zeros(0, "int64"), limit)) == 0 and len(jaccard.marks_of(np.array([0, TOP - 1]), TOP)) == 4


def test_groups_are_narrowed_without_a_copy_of_the_tokens_for_each(spark):
    rng, n, tokens, each = np.random.default_rng(6), 40, 6000, 3
    p = jaccard.Params(5, 80)
    lows = [np.sort(rng.integers(0, int(0.29 * TOP), tokens)) for _ in range(n)]
    lows[1] = lows[0].copy()  # the one pair that may be alike
    classes = spark.createDataFrame([(k, tokens * 3, low.tolist()) for k, low in enumerate(lows)], "id long, n long, low array<bigint>")
    members = spark.createDataFrame([(g * n + k // 4, k) for g in range(each) for k in range(n)], "group long, id long")
    store = spark.sparkContext._jsc.sc().statusStore()
    spark.sparkContext.setJobGroup("narrowed", "narrowed")
    try:
        left = jaccard.narrowed(members, classes, p).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("narrowed") for s in tracker.getJobInfo(j).stageIds}
    moved = sum(store.lastStageAttempt(s).shuffleWriteBytes() for s in stages)
    assert {r.id for r in left} == {0, 1}
    assert 0 < moved < 2 * 8 * tokens * n
