"""Second moments of many columns, with gaps, against numpy."""

import time

import numpy as np
from pyspark.sql import functions as F

from tablegauge.operators import complexity as X
from tablegauge.operators import gram as G
from tablegauge.operators import moments as M


def test_gaps_null_labels_and_single_rows(spark, monkeypatch):
    monkeypatch.setattr(G, "HELD", 100)  # sums are handed on after every batch
    rng = np.random.default_rng(1)
    rows = [(None if k % 5 == 0 else "ab"[k % 2], *[None if rng.random() < 0.2 else float(v) for v in rng.normal(1e6, 3, 3)]) for k in range(200)] + [("c", 1.0, 2.0, None), ("d", None, None, None)]
    df = spark.createDataFrame(rows, "label string, `a b` double, b double, label2 double").repartition(5)
    got = {(r["label"], r["a"], r["b"]): r["covariance"] for r in M.class_covariance(df, "label", ["a b", "b", "label2"]).collect()}
    exact = {}
    for i, x in enumerate(["a b", "b", "label2"]):
        for y in ["a b", "b", "label2"][i:]:
            for r in df.groupBy("label").agg(F.covar_samp(f"`{x}`", f"`{y}`").alias("c")).collect():
                exact[r["label"], x, y] = r["c"]
    assert got.keys() == exact.keys()
    assert all(got[k] is None if exact[k] is None else abs(got[k] - exact[k]) < 1e-6 * (1 + abs(exact[k])) for k in got)
    assert M.class_covariance(df.where("false"), "label", ["b"]).count() == 0


def test_seventy_columns_in_seconds(spark):
    n, p = 3000, 70
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, p)) @ rng.normal(size=(p, p))
    names = [f"f{i}" for i in range(p)]
    df = spark.createDataFrame([(i % 3, *x[i].tolist()) for i in range(n)], "y int, " + ", ".join(f"{c} double" for c in names)).repartition(4).cache()
    df.count()
    began = time.perf_counter()
    got = X.mahalanobis(df, "y", names).first()
    assert time.perf_counter() - began < 60
    d = np.zeros(n)
    for k in range(3):
        own = x[k::3]
        e = own - own.mean(axis=0)
        d[k::3] = np.sqrt(np.einsum("ij,jk,ik->i", e, np.linalg.inv(np.cov(own.T) + 1e-6 * np.eye(p)), e))
    assert got["size"] == n
    for name, want in (("mean", d.mean()), ("max", d.max()), ("median", np.median(d)), ("std", d.std())):
        assert abs(got[name] - want) < 1e-6, name
    df.unpersist()


def test_rows_with_a_gap_have_no_distance(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0), (0, 2.0, None), (0, 3.0, 1.0), (0, 4.0, 4.0)], "y int, a double, b double")
    assert X.mahalanobis(df, "y", ["a", "b"]).first()["size"] == 3
