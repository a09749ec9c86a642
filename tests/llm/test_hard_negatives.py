"""Hard negatives from packed trees against all scores."""

import math
import random
import struct

import duckdb
import numpy as np
import pytest

from tablegauge.llm import hard_negatives as hn
from tablegauge.llm.queries import OP13_SQL, op13_hard_negatives


def brute(rows, every=100, positives=5, negatives=10):
    """``rows(id, label, integers)``: every score of every anchor."""
    out = []
    for a, la, va in rows:
        if a % every:
            continue
        scored = sorted((-int(np.dot(va, v)), i, lb) for i, lb, v in rows if i != a)
        for s, i, _ in [x for x in scored if x[2] == la][:positives]:
            inside = [x for x in scored if x[2] != la and 30 * -s <= 100 * -x[0] <= 90 * -s][:negatives]
            out += [(a, i, k + 1, x[1], -s, -x[0]) for k, x in enumerate(inside)]
    return sorted(out)


def mined(spark, rows, **options):
    data = [(i, lb, struct.pack(f"<{len(v)}i", *map(int, v))) for i, lb, v in rows]
    out = hn.mined(spark.createDataFrame(data, "vec_id long, label long, v binary"), **options)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, out.collect()))


@pytest.mark.parametrize("kind", ["clusters", "copies", "narrow", "huge"])
def test_mined_equals_all_scores(spark, kind):
    rng = np.random.default_rng(7)
    n, d = 900, {"narrow": 1}.get(kind, 12)
    centres = rng.integers(-200, 200, (5, d))
    v = centres[rng.integers(0, 5, n)] + rng.integers(-40, 40, (n, d))
    if kind == "copies":
        v[: n // 2] = v[0]
    if kind == "huge":
        v = v * 100_000
    rows = [(int(k) * 2, int(rng.integers(0, 4)) if k % 3 else 0, v[k]) for k in range(n)]
    assert mined(spark, rows, every=50, tile=96, sample=300) == brute(rows, every=50)


def test_single_tile_few_rows_and_none(spark):
    rows = [(0, 1, [3, 4]), (1, 1, [3, 4]), (2, 2, [2, 2]), (3, 2, [0, 0]), (100, 9, [1, 1]), (-100, 2, [-3, -4])]
    rows = [(i, lb, np.array(v)) for i, lb, v in rows]
    assert mined(spark, rows) == brute(rows) != []
    assert mined(spark, []) == []
    assert mined(spark, [(0, 1, np.zeros(0)), (1, 1, np.zeros(0)), (2, 2, np.zeros(0))]) == brute([(0, 1, np.zeros(0)), (1, 1, np.zeros(0)), (2, 2, np.zeros(0))])


def test_query_equals_sql_on_odd_rows(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, rng.randint(0, 9), [rng.gauss(0, 0.3) for _ in range(8)]) for k in range(400)]
    rows += [(400, None, [1.0] * 8), (500, 1, None), (600, 1, [math.nan] * 8), (601, 1, [math.inf] + [0.0] * 7), (602, 1, [None] + [1.0] * 7), (700, 3, [0.5] * 8), (-100, 3, [0.5] * 8), (2**53 + 1, 3, [0.5] * 8)]
    spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<float>, tile string").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, op13_hard_negatives(spark, str(tmp_path)).collect()))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == sorted(db.sql(OP13_SQL).fetchall()) != []


def test_vectors_that_take_no_part(spark):
    rows = [(1, 1, [0.5, -0.001]), (1, 1, [0.5, -0.001]), (1, 0, [9.0]), (None, 1, [1.0]), (2, 1, [1e30]), (3, 1, []), (4, 1, [1.0, 2.0, 3.0])]
    got = {r["vec_id"]: (r["label"], np.frombuffer(r["v"], "<i4").tolist()) for r in hn.integer_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")).collect()}
    assert got == {1: (0, [2304, 0, 0]), 3: (1, [0, 0, 0]), 4: (1, [256, 512, 768])}


def test_boxes_prune(monkeypatch):
    """On clustered rows a search looks at a small part of the leaves, and finds the same."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-1000, 1000, (40, 3))
    points = (centres[np.repeat(np.arange(40), 100)] + rng.integers(-5, 5, (4000, 3))).astype("<i4")
    order = hn.str_order(points)
    tree = hn.Tree(np.arange(4000)[order], np.zeros(4000, np.int64), points[order])
    asked = []
    scores = hn.Tree.scores
    monkeypatch.setattr(hn.Tree, "scores", lambda self, a, b, q: asked.append(a) or scores(self, a, b, q))
    found = tree.search(points[17], 17, 0, True, np.array([-(2**62)]), np.array([2**62]), 5)
    exact = sorted((-int(points[17].astype(int) @ p), i) for i, p in enumerate(points.astype(int)) if i != 17)[:5]
    assert found == [exact] and len(asked) < 4000 / hn.LEAF / 4
