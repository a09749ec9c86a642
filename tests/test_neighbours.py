"""Exact neighbours against all pairs, on odd rows, and the pairs that are measured."""

import numpy as np
import pytest

from tablegauge.operators import metric_neighbours as N


def brute(rows, k, own=False, within=False):
    """``rows(key, label, vector)``: neighbours by distance, then key; unknown distances last."""
    width = max((len(v) for _, _, v in rows if v is not None), default=0)
    sound = lambda v: v is not None and len(v) == width > 0 and all(x is not None and np.isfinite(x) for x in v)
    out = {}
    for key, label, v in rows:
        if key is None:
            continue
        seen = []
        for other, other_label, u in rows:
            if other is None or (other == key and not own) or (within and other_label != label):
                continue
            d = None
            if sound(v) and sound(u):
                d = 0.0
                for a, b in zip(v, u, strict=True):
                    d += (a - b) ** 2
                d = float(np.sqrt(d))
            seen.append((d is None, d or 0.0, other, other_label, d))
        out[key] = [(o, ol, d) for _, _, o, ol, d in sorted(seen, key=lambda x: x[:3])[:k]]
    return out


def got(spark, rows, k, kinds="k long, l int, v array<double>", **options):
    near = {}
    for r in N.nearest(spark.createDataFrame(rows, kinds), "k", "l", "v", k, **options).orderBy("key", "rank").collect():
        near.setdefault(r["key"], []).append((r["other"], r["other_label"], r["distance"]))
        assert r["rank"] == len(near[r["key"]])
    return near


def table(seed, n, d):
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(n, d)) + 6 * rng.integers(0, 4, (n, 1))).round(1)
    x[rng.integers(0, n, n // 4)] = x[0]  # a common vector
    x[rng.integers(0, n, n // 8)] += 1e6
    return [(int(i) * 3 - 50, int(i % 3), x[i].tolist()) for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"include_self": True}, {"within": True}])
def test_equal_to_all_pairs_in_small_blocks(spark, options):
    rows = table(1, 500, 3)
    want = brute(rows, 4, options.get("include_self", False), options.get("within", False))
    assert got(spark, rows, 4, block=16, **options) == want


def test_many_stripes_and_many_neighbours(spark, monkeypatch):
    monkeypatch.setattr(N, "STRIPE", 3)
    rows = table(2, 500, 2)
    assert got(spark, rows, 22, block=16) == brute(rows, 22)


def test_text_keys_null_labels_and_unknown_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(f"r{k:03}", None if k % 7 == 0 else "ab"[k % 2], rng.normal(size=2).round(1).tolist()) for k in range(60)]
    rows += [("u1", "a", None), ("u2", "b", [1.0]), ("u3", None, [1.0, None]), ("u4", "a", [float("nan"), 0.0]), ("u5", "a", [float("inf"), 0.0]), (None, "a", [0.0, 0.0]), ("z", "c", [0.0, 0.0])]
    kinds = "k string, l string, v array<double>"
    assert got(spark, rows, 3, kinds) == brute(rows, 3)
    # more neighbours asked for than there are: unknown distances come last
    assert got(spark, rows, 64, kinds) == brute(rows, 64)
    assert got(spark, rows, 3, kinds, within=True) == {k: v for k, v in brute(rows, 3, within=True).items() if v}


def test_none_and_one_row(spark):
    assert got(spark, [], 2) == {}
    assert got(spark, [(1, 0, [1.0])], 2) == {}
    assert got(spark, [(1, 0, [1.0])], 2, include_self=True) == {1: [(1, 0, 0.0)]}
    assert got(spark, [(1, 0, []), (2, 0, None)], 2) == {1: [(2, 0, None)], 2: [(1, 0, None)]}


def test_pairs_grow_far_below_the_square(spark):
    """Four times the rows on a plane: about four times the pairs, a few hundredths of all of them."""
    pairs = []
    for n in (1500, 6000):
        x = np.random.default_rng(5).uniform(size=(n, 2))
        rows = spark.createDataFrame([(i, 0, x[i].tolist()) for i in range(n)], "k long, l int, v array<double>")
        counter = spark.sparkContext.accumulator(0)
        assert N.nearest(rows, "k", "l", "v", 3, block=32, measured=counter).count() == 3 * n
        pairs.append(counter.value / n**2)
    assert pairs[1] < pairs[0] / 2 and pairs[1] < 0.1


def test_mixed_rows(spark):
    """Numbers between a row and its neighbour in the mixed distance, categories the neighbours' mode; gaps and single rows."""
    from tablegauge.operators.neighbour_sampling import smote_mixed

    rows = [(k, "a", float(k), "xyx"[k % 3] if k % 4 else None, "p") for k in range(12)] + [(50, "b", 1.0, "x", "p"), (51, None, 2.0, "x", "p"), (52, "a", None, "x", "p"), (None, "a", 3.0, "x", "p"), (60, "c", 1.0, "q", "r"), (61, "c", 1.0, "s", None)]
    df = spark.createDataFrame(rows, "k long, l string, x double, c string, d string")
    wanted = spark.createDataFrame([("a", 30), ("b", 5), ("c", 2), (None, 4)], "l string, n int")
    made = smote_mixed(df, "k", "l", ["x"], ["c", "d"], wanted, k=3).collect()
    assert sorted({r["l"] for r in made}) == ["a", "c"] and len(made) == 32
    own = {r[0]: r for r in rows if r[1] == "a" and r[0] is not None and r[2] is not None}
    weight = float(np.std([r[2] for r in own.values()])) ** 2
    for r in (m for m in made if m["l"] == "a"):
        base = own[r["base"]]
        near = sorted((float(np.sqrt((base[2] - o[2]) ** 2 + weight * ((base[3] != o[3]) + (base[4] != o[4])))), k) for k, o in own.items() if k != base[0])[:3]
        assert r["neighbour"] in [k for _, k in near]
        low, high = sorted((base[2], own[r["neighbour"]][2]))
        assert low <= r["numbers"][0] <= high
        seen = [own[k][3] for _, k in near]
        assert r["categories"]["c"] == min(set(seen), key=lambda v: (-seen.count(v), v is None, v or "")) and r["categories"]["d"] == "p"
    assert {(r["base"], r["neighbour"]) for r in made if r["l"] == "c"} <= {(60, 61), (61, 60)}


def test_codes_of_values_that_begin_alike(spark):
    from tablegauge.operators import encode

    values = [f"Customer#{k:09}" for k in range(500)] + ["", "Customer", "é", None, "Customer#000000007"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = {r["value"]: r["code"] for r in encode.label_codes(df, "v").collect()}
    assert got == {v: i for i, v in enumerate(sorted({v for v in values if v is not None}))}
    assert encode.label_codes(df.where("false"), "v").count() == 0
    numbers = spark.createDataFrame([(3.5,), (-1.0,), (3.5,), (None,)], "v double")
    assert sorted(tuple(r) for r in encode.label_codes(numbers, "v").collect()) == [(-1.0, 0), (3.5, 1)]


@pytest.mark.parametrize("few", [4096, 8, 1])
def test_neighbours_of_some_rows(spark, monkeypatch, few):
    """Those that are asked for, as if all were, however many passes they take; they alone are measured."""
    monkeypatch.setattr(N, "FEW", few)
    rows = [*table(6, 300, 3), (9000, 1, None), (9003, 2, [1.0]), (9006, None, [0.0, 1.0, 2.0])]
    keys = [k for k, _, _ in rows[::19]] + [9000, 9006]
    asked = spark.createDataFrame([(k,) for k in [*keys, keys[0], 123456, None]], "key long")
    for options in ({}, {"include_self": True}, {"within": True}):
        want = brute(rows, 4, options.get("include_self", False), options.get("within", False))
        assert got(spark, rows, 4, block=16, asked=asked, **options) == {k: want[k] for k in keys if want[k]}


def test_blocks_that_reach_all_are_asked_together(spark, monkeypatch):
    """Where nothing can be left out, the stream is sent once for many blocks."""
    monkeypatch.setattr(N, "GROUPS", 4)
    monkeypatch.setattr(N, "ROWS", 16)
    monkeypatch.setattr(N, "COLUMNS", 8)
    x = np.random.default_rng(7).normal(size=(400, 12))
    rows = [(int(i), int(i % 3), x[i].tolist()) for i in range(400)]
    groups, made = [], N._groups

    def seen(*args):
        groups.append(made(*args))
        return groups[-1]

    monkeypatch.setattr(N, "_groups", seen)
    assert got(spark, rows, 5, block=16) == brute(rows, 5)
    counts = groups[0].agg({"asking": "count"}).first()[0], groups[0].select("group").distinct().count()
    assert counts[0] > 16 and counts[1] <= 8
