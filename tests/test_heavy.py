"""Top counts from summaries are those of a full count, also when the summaries are too small."""

import random
from collections import Counter

import pytest

from domlens.operators import heavy as H


def items(n, spread):
    rng = random.Random(n)
    return [(g, f"i{int(rng.paretovariate(spread)) if rng.random() < 0.7 else rng.randint(1, 4000)}", rng.randint(1, 3)) for g in ("2", "3") for _ in range(n)]


@pytest.mark.parametrize("capacity,enough", [(5_000, True), (300, None), (4, False)])
def test_top_counts_are_exact(spark, capacity, enough):
    rows = items(6_000, 0.8) + [("other", "x", 9)]
    df = spark.createDataFrame(rows, "grp string, item string, times long").repartition(6)
    limits = {"2": 10, "3": 25}
    found, sufficed = H.top_counts(df, limits, capacity)
    want = []
    for g, k in limits.items():
        counts = Counter()
        for a, i, n in rows:
            if a == g:
                counts[i] += n
        want += [(g, i, n) for i, n in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:k]]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert enough is None or sufficed == enough


def test_small_and_empty_groups(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 1)], "grp string, item string, times long")
    found, sufficed = H.top_counts(df, {"a": 5, "none": 3}, 10)
    assert sorted(map(tuple, found.collect())) == [("a", "x", 1), ("a", "y", 1)] and sufficed
    assert H.top_counts(df.limit(0), {"a": 5}, 10)[0].collect() == []
