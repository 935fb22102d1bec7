"""Ranked findings against plain counting."""

import random
from collections import defaultdict

import pytest

from reqlake.operators import outliers


def brute(rows, limit):
    keys = defaultdict(set)
    for key, finding in rows:
        if key is not None and finding is not None:
            keys[finding].add(key)
    top = sorted(keys, key=lambda f: (-len(keys[f]), f))[:limit]
    return sorted((f, len(keys[f]), ", ".join(sorted(keys[f])[:5])) for f in top)


@pytest.mark.parametrize("case", ["zipf", "flat", "few", "hot key", "empty"])
def test_ranked_findings_are_exact(spark, case):
    rng = random.Random(case)
    if case == "zipf":  # the sketch overflows, and the candidates are certain
        rows = [(f"k{i % 700}", f"f{int(400 ** rng.random()) if rng.random() < 0.9 else rng.randrange(3000)}") for i in range(9000)]
    elif case == "flat":  # nothing stands out: every pair is counted
        rows = [(f"k{rng.randrange(99)}", f"f{rng.randrange(2000)}") for _ in range(6000)]
    elif case == "few":
        rows = [(f"k{i}", f"f{i % 3}") for i in range(40)] * 3 + [(None, "f0"), ("k", None)]
    elif case == "hot key":  # most rows are of one key, so rows say little about keys
        rows = [("hot", f"f{i % 5}") for i in range(4000)] + [(f"k{i}", f"g{i % 20}") for i in range(400)]
    else:
        rows = []
    table = spark.createDataFrame(rows, "key string, finding string")
    for limit in (1, 12):
        assert sorted(map(tuple, outliers.ranked(table, limit, tracked=128).collect())) == brute(rows, limit)


def test_most_findings_need_no_count_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(outliers, "_counted", None)
    rows = [(f"k{i}", f"f{j}") for i in range(300) for j in range(20) if i % (j + 1) == 0] + [(f"k{i}", f"rare{i}") for i in range(300)]
    table = spark.createDataFrame(rows, "key string, finding string")
    assert sorted(map(tuple, outliers.ranked(table, 5, tracked=256).collect())) == brute(rows, 5)
