"""Jobs over many tables, and the result store."""

import math

import pytest
from pyspark.sql import functions as F

from tablegauge.operators import many as M
from tablegauge.sources import result_store as S


@pytest.fixture
def tables(spark):
    a = spark.createDataFrame([(k, "xy"[k % 2], float(k % 2) + k / 1000, k % 3, None if k == 7 else 1.0) for k in range(300)] + [(400, "x", 0.0, 0, 1.0), (401, None, 1.0, 1, 1.0), (402, "y", float("inf"), 1, 1.0), (403, "x", 0.0, 0, 1.0)], "k long, l string, p double, q int, r double")
    b = spark.createDataFrame([(f"r{k}", k % 4, float(k * k % 97) + k / 10000) for k in range(200)], "id string, class int, z double")
    return {"a": M.Labelled(a, "k", "l", ("p", "q", "r")), "b": M.Labelled(b, "id", "class", ("z",)), "none": M.Labelled(b.where("false"), "id", "class", ("z",))}


def test_tables_are_cleaned_prepared_and_measured_together(tables):
    rows = M.cleaned(M.stacked(tables))
    assert {r["dataset_id"]: r["count"] for r in rows.groupBy("dataset_id").count().collect()} == {"a": 299, "b": 200}  # 7 has a gap, 400 and 403 repeat 0
    long = M.prepared(rows, few=10)
    got = {(r["dataset_id"], r["feature"]): (r["m"], r["s"]) for r in long.groupBy("dataset_id", "feature").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s")).collect()}
    assert abs(got["a", 0][0]) < 1e-9 and abs(got["a", 0][1] - 1) < 1e-9 and abs(got["b", 0][1] - 1) < 1e-9
    assert got["a", 2] == (1.0, 0.0) and 0.3 < got["a", 1][0] < 0.4
    found = {r["dataset_id"]: r for r in M.metrics(long).collect()}
    assert set(found) == {"a", "b"} and found["a"]["n_features"] == 3 and found["a"]["n_rows"] == 299 and found["b"]["n_classes"] == 4
    assert found["a"]["anova_f_mean"] > found["b"]["anova_f_mean"] and abs(found["b"]["normalized_entropy"] - 1) < 1e-9
    d = {r["dataset_id"]: r["difficulty"] for r in M.difficulty(M.metrics(long)).collect()}
    assert set(d) == {"a", "b"} and all(0 <= v <= 1 for v in d.values())


def test_few_values_are_sent_to_rows_without_keys(tables):
    """No row is shuffled to be prepared but in counts, and keys are not written."""
    rows = M.cleaned(M.stacked(tables))
    plain = M.prepared(rows, few=10, keyed=False)
    keyed = M.prepared(rows, few=10).drop("key")
    assert plain.columns == ["dataset_id", "label", "feature", "value"]
    near = lambda df: df.withColumn("value", F.round("value", 9))  # noqa: E731 - means are added up in any order
    assert near(plain).exceptAll(near(keyed)).count() == 0 and plain.count() == keyed.count() == 299 * 3 + 200
    assert "SortMergeJoin" not in plain._jdf.queryExecution().executedPlan().toString()


def test_difficulty_and_scores(spark):
    found = spark.createDataFrame([("a", 0.1), ("b", 0.5), ("c", 0.9)], "dataset_id string, difficulty double")
    results = spark.createDataFrame([("a", "m", 0.9, 1.0), ("b", "m", 0.8, 5.0), ("c", "m", 0.1, 2.0), ("x", "m", 0.0, 0.0)], "dataset_id string, model string, f1 double, seconds double")
    got = {r["metric"]: r for r in M.related(found, results, ["f1", "seconds"], "model").collect()}
    assert got["f1"]["spearman"] == -1.0 and got["f1"]["kendall"] == -1.0 and abs(got["seconds"]["kendall"] - 1 / 3) < 1e-12


def test_store_replaces_and_restores(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    assert S.get(spark, path, "trials").count() == 0 and S.index(spark, path).count() == 0
    trials = spark.createDataFrame([(0, {"depth": "3"}, 0.5, "ok"), (1, {"depth": "4"}, None, "it's \"bad\"\n"), (2, None, math.nan, "ok")], "trial int, parameters map<string,string>, f1 double, status string")
    S.put(trials, path, "trials", "iris")
    S.put(spark.createDataFrame([(7, 2**60 + 1)], "trial int, seed long"), path, "trials", "wine")
    S.put(spark.createDataFrame([("a", 0.5)], "feature string, importance double"), path, "importance", "iris")
    got = {(r["dataset_id"], r["trial"]): r for r in S.get(spark, path, "trials").collect()}
    assert got["iris", 0]["parameters"] == {"depth": "3"} and got["iris", 1]["f1"] is None and got["iris", 1]["status"] == "it's \"bad\"\n" and math.isnan(got["iris", 2]["f1"])
    assert got["wine", 7]["seed"] == 2**60 + 1 and got["wine", 7]["status"] is None
    S.put(trials.where("trial = 2"), path, "trials", "iris")
    assert {(r["dataset_id"], r["trial"]) for r in S.get(spark, path, "trials").collect()} == {("iris", 2), ("wine", 7)}
    many = spark.createDataFrame([("wine", 1), ("oak", 2)], "dataset_id string, trial int")
    S.put(many, path, "trials")
    assert {(r["dataset_id"], r["trial"]) for r in S.get(spark, path, "trials").collect()} == {("iris", 2), ("wine", 1), ("oak", 2)}
    S.put(trials.where("false"), path, "trials", "iris")
    assert {r["dataset_id"] for r in S.get(spark, path, "trials").collect()} == {"wine", "oak"}
    S.write_index(spark, path, f"{path}-index")
    assert [(r["kind"], r["dataset_id"], r["n_rows"], r["n_columns"], r["position"]) for r in S.read_index(spark, f"{path}-index").orderBy("kind", "position").collect()] == [("importance", "iris", 1, 2, 0), ("trials", "iris", 0, 4, 0), ("trials", "oak", 1, 1, 1), ("trials", "wine", 1, 1, 2)]


def test_ranks_in_any_order(spark):
    from tablegauge.operators.ordering import ranked_in_order

    rows = [(None if k % 9 == 0 else "ab"[k % 2], None if k % 5 == 0 else k % 7, k) for k in range(400)]
    df = spark.createDataFrame(rows, "g string, v int, k long")
    got = {r["k"]: r["rank"] for r in ranked_in_order(df, ["g"], [F.desc_nulls_last("v"), F.col("k")]).collect()}
    for g in (None, "a", "b"):
        own = sorted((v is None, -(v or 0), k) for h, v, k in rows if h == g)
        assert [got[k] for _, _, k in own] == list(range(1, len(own) + 1))
    assert ranked_in_order(df.where("false"), ["g"], [F.col("k")]).count() == 0


def test_difficulty_is_of_all_rows(spark, tmp_path, monkeypatch):
    """No sample is drawn: every row without gaps is prepared and measured."""
    from tablegauge.plans import many

    d = f"file://{tmp_path}"
    made = {
        "lineitem": ("id as l_orderkey", "1 as l_linenumber", "substring('ANR', int(id % 3) + 1, 1) as l_returnflag", "id * 1D as l_quantity", "id * 3D as l_extendedprice", "id % 7 * 1D as l_discount", "id % 5 * 1D as l_tax"),
        "orders": ("id as o_orderkey", "substring('FO', int(id % 2) + 1, 1) as o_orderstatus", "id * 2D as o_totalprice", "id % 9 as o_custkey"),
        "customer": ("id as c_custkey", "concat('m', id % 2) as c_mktsegment", "id * 5D as c_acctbal", "id % 4 as c_nationkey"),
        "part": ("id as p_partkey", "concat('b', id % 3) as p_brand", "id * 7D as p_retailprice", "id % 8 as p_size"),
        "supplier": ("id as s_suppkey", "id % 2 as s_nationkey", "id * 1.5D as s_acctbal"),
    }
    for name, columns in made.items():
        spark.range(60).selectExpr(*columns).write.parquet(f"{d}/{name}.parquet")
    seen = []
    metrics = many.M.metrics
    monkeypatch.setattr(many.M, "metrics", lambda long: seen.append({r["dataset_id"]: r["n_rows"] for r in metrics(long).collect()}) or metrics(long))
    assert many.many_tables_difficulty(spark, d).count() == 5
    assert seen == [dict.fromkeys(made, 60)]
