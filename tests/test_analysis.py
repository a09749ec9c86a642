"""Kendall's tau by ranges against all pairs."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tablegauge.operators import analysis as N


def all_pairs(points):
    return sum(int(np.sign((a[0] - b[0]) * (a[1] - b[1]))) * a[2] * b[2] for i, a in enumerate(points) for b in points[:i])


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.tuples(st.integers(0, 6), st.integers(-3, 9)), st.integers(1, 4), max_size=30))
def test_pair_score(points):
    rows = [(x, y, n) for (x, y), n in points.items()]
    x, y, n = (np.array([r[i] for r in rows], float if i < 2 else int) for i in range(3))
    assert N.pair_score(x, y, n) == all_pairs(rows)


@pytest.mark.parametrize("ranges", [4, 256])
def test_groups_ties_and_a_frequent_value(spark, monkeypatch, ranges):
    monkeypatch.setattr(N, "RANGES", ranges)
    rng = random.Random(ranges)
    rows = [("a", rng.randint(0, 40), rng.gauss(0, 1)) for _ in range(300)]
    rows += [("b", 7 if rng.random() < 0.5 else rng.randint(0, 30), round(rng.gauss(0, 1), 1)) for _ in range(300)]
    rows += [(None, float(k), -k) for k in range(20)] + [("c", 1, 2), ("c", 1, 3), ("d", 5, 5), ("a", None, 1)]
    rows = [(g, None if x is None else float(x), float(y)) for g, x, y in rows]
    got = {r["g2"]: r for r in N.correlations(spark.createDataFrame(rows, "g2 string, u double, v double"), "u", "v", "g2").collect()}
    for g in ("a", "b", None):
        own = [(x, y, 1) for k, x, y in rows if k == g and x is not None]
        ties = lambda i: sum(np.sum([p[i] == q[i] for q in own[:j]]) for j, p in enumerate(own))  # noqa: E731, B023
        total = len(own) * (len(own) - 1) / 2
        assert abs(got[g]["kendall"] - all_pairs(own) / np.sqrt((total - ties(0)) * (total - ties(1)))) < 1e-12
    assert got["c"]["kendall"] is None and got["d"]["kendall"] is None and got[None]["kendall"] == -1.0


def test_many_pairs(spark):
    """No pair of rows is joined; independent columns have a tau near 0, a shifted copy one of 1."""
    n = 100_000
    x = spark.range(n).selectExpr("double(id) as u", "double(xxhash64(id)) as v", "double(id) * 2 - 7 as w")
    assert abs(N.correlations(x, "u", "v").first()["kendall"]) < 0.01
    assert abs(N.correlations(x, "u", "w").first()["kendall"] - 1) < 1e-12
