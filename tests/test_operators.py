"""Edge cases of the operators on literal tables."""

import math

import pytest
from pyspark.sql import functions as F

from tablegauge.operators import clean as C
from tablegauge.operators import complexity as X
from tablegauge.operators import difficulty as D
from tablegauge.operators import encode as E
from tablegauge.operators import evaluate as V
from tablegauge.operators import moments as M
from tablegauge.operators import neighbour_sampling as B
from tablegauge.operators import profile as P
from tablegauge.operators import sample as A


@pytest.fixture
def messy(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1.0, 1.0, "a", "x", None), (1.0, 1.0, "a", "x", None), (None, 2.0, "b", "y", None), (nan, 3.0, "c", "y", None), (inf, 4.0, None, "x", None), (2.0, -inf, "d", "y", None)]
    return spark.createDataFrame(rows, "a double, b double, s string, label string, empty double")


def test_infinite_rows_go_and_nulls_stay(messy):
    assert C.drop_infinite(messy).count() == 4


def test_clean_matrix(messy):
    out = C.clean_matrix(messy)
    assert out.columns == ["a", "b", "s", "label"] and [tuple(r) for r in out.collect()] == [(1.0, 1.0, "a", "x")]


def test_names_that_clash(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`a-b` int, `a b` int, label int")
    assert C.normalized_columns(df, "label").columns == ["A_B", "A_B_2", "label"]


def test_vanished_class_keeps_its_best_row(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 1.0), (3, "b", 1.0), (4, "b", 9.0)], "k int, label string, m double")
    assert sorted(r["k"] for r in C.row_mean_filter(df, "label", "m", "k", 0.5).collect()) == [2, 4]


def test_types_are_inferred_from_values(spark):
    df = spark.createDataFrame([("1", "1.5", "x", None), ("2", "2", "1", None)], "i string, f string, c string, n string")
    assert {r["column"]: r["kind"] for r in P.infer_types(df).collect()} == {"i": "integer", "f": "float", "c": "categorical", "n": "unknown"}
    assert dict(P.numeric_text(df).dtypes) == {"i": "double", "f": "double", "c": "string", "n": "string"}


def test_shrink_keeps_wide_values(spark):
    df = spark.createDataFrame([(1, 2**40, 1.5)], "a bigint, b bigint, c double")
    assert dict(P.shrink(df).dtypes) == {"a": "int", "b": "bigint", "c": "float"}
    assert dict(P.shrink(df, narrowest=True).dtypes)["a"] == "tinyint"


def test_quantile_bins_drop_equal_edges(spark):
    df = spark.createDataFrame([(1.0,)] * 9 + [(5.0,)], "x double")
    assert {r["b"] for r in E.quantile_bins(df, "x", "b", 4).collect()} == {"Q1"}


def test_constant_columns_scale_to_zero(spark):
    df = spark.createDataFrame([(3.0, 1.0), (3.0, 2.0)], "x double, y double")
    for method in ("standard", "minmax", "robust"):
        assert [r["x"] for r in E.scaled(df, ["x"], method).collect()] == [0.0, 0.0]


def test_one_hot_drops_the_first(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    assert E.one_hot(df, "x", drop_first=True).columns == ["x", "x_b"]


def test_hash_buckets():
    assert [E.hash_buckets(n) for n in (1, 100, 10**9)] == [2, 128, 1 << 16]


@pytest.fixture
def classes(spark):
    sizes = {"a": 1, "b": 2, "c": 5, "d": 10, "e": 100}
    return spark.createDataFrame([(f"{c}{i}", c, float(i)) for c, n in sizes.items() for i in range(n)], "k string, label string, x double")


def test_oversampling_adds_the_minimum(classes):
    counts = {r["label"]: r["count"] for r in A.oversample_min(classes, "label", "k", 5).groupBy("label").count().collect()}
    assert counts == {"a": 6, "b": 7, "c": 5, "d": 10, "e": 100}


def test_split_is_disjoint_and_covers_classes(classes):
    split = A.stratified_split(classes, "label", "k")
    assert split.count() == 118 and split.groupBy("k").agg(F.count_distinct("subset").alias("n")).where("n > 1").count() == 0
    big = split.where("label in ('c', 'd', 'e')").groupBy("subset").agg(F.count_distinct("label").alias("n"))
    assert {r["n"] for r in big.collect()} == {3}


def test_fractions_are_nested(classes):
    small, large = (A.fraction_sample(classes, "k", f) for f in (0.2, 0.6))
    assert small.join(large, "k", "left_anti").count() == 0


def test_resampling_drops_a_class_of_target_zero(spark, classes):
    targets = spark.createDataFrame([("a", 3), ("e", 0), ("d", 4)], "label string, total long")
    assert {r["label"]: r["count"] for r in A.resample(classes, "label", "k", targets).groupBy("label").count().collect()} == {"a": 3, "d": 4}


def test_anova_counts_but_skips_single_rows(spark, classes):
    f = X.anova_f(M.class_moments(classes, "label", ["x"])).first()["f"]
    assert f > 0
    flat = classes.withColumn("x", F.lit(2.0))
    assert X.anova_f(M.class_moments(flat, "label", ["x"])).first()["f"] == 0.0


def test_one_class_is_balanced(spark):
    df = spark.createDataFrame([("a",), ("a",)], "label string")
    assert tuple(X.class_imbalance(df, "label").first()) == (1, 1.0, 1.0)


def test_neighbours_refuse_large_tables(spark):
    df = spark.range(20).select("id", F.lit(0).alias("label"), F.array(F.col("id").cast("double")).alias("v"))
    with pytest.raises(ValueError):
        X.neighbours(df, "id", "label", "v", 2, most_rows=10)
    near = X.neighbours(df, "id", "label", "v", 2).where("key = 5").orderBy("rank").collect()
    assert [(r["other"], r["distance"]) for r in near] == [(4, 1.0), (6, 1.0)]


def test_approximate_neighbours_find_most(spark):
    df = spark.range(200).select("id", (F.col("id") % 2).alias("label"), F.array((F.col("id") * 1.0), F.lit(0.0)).alias("v"))
    near = X.approximate_neighbours(df, "id", "label", "v", 2, bucket=8.0)
    exact = X.neighbours(df, "id", "label", "v", 2)
    hit = exact.select("key", "other").intersect(near.select("key", "other")).count()
    assert hit >= 0.9 * exact.count()


def test_nearest_is_exact_above_the_broadcast_bound(spark):
    import numpy as np

    n, k = 5300, 5
    x = np.random.default_rng(3).normal(size=(n, 6)).round(1)
    x[5000:5200] = x[7]  # one common vector
    df = spark.createDataFrame([(i, i % 3, x[i].tolist()) for i in range(n)], "id long, label int, v array<double>")
    sample = [0, 7, 1234, 5100, 5299]
    for kept, (own, within) in {"all": (False, False), "self": (True, False), "class": (False, True)}.items():
        got = {}
        for r in X.nearest(df, "id", "label", "v", k, own, within).where(F.col("key").isin(sample)).collect():
            got[r["key"], r["rank"]] = r["other"], r["distance"]
        for i in sample:
            d = np.zeros(n)
            for c in range(x.shape[1]):
                d += (x[i, c] - x[:, c]) ** 2
            order = [j for j in np.lexsort((np.arange(n), d)).tolist() if (own or j != i) and (not within or j % 3 == i % 3)][:k]
            assert [got[i, r + 1] for r in range(k)] == [(j, float(np.sqrt(d[j]))) for j in order], (kept, i)


def test_smote_above_the_broadcast_bound(spark):
    df = spark.range(5100).select("id", (F.col("id") % 2).cast("int").alias("label"), F.array(F.col("id").cast("double")).alias("v"))
    wanted = spark.createDataFrame([(0, 8), (1, 3)], "label int, n int")
    made = B.smote(df, "id", "label", "v", wanted, k=2).collect()
    assert len(made) == 11 and all(abs(r["base"] - r["neighbour"]) in (2, 4) for r in made)


def test_pareto_ties(spark):
    rows = [(1, 1.0, 0.5), (2, 1.0, 0.7), (3, 2.0, 0.7), (4, 3.0, 0.9), (5, 3.0, 0.9), (6, 4.0, 0.8)]
    df = spark.createDataFrame(rows, "n int, latency double, f1 double")
    assert sorted(r["n"] for r in V.pareto_front(df, "latency", "f1").collect()) == [2, 4, 5]


def test_metrics_of_hand_computed_predictions(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "y int, yhat int")
    r = {x["metric"]: x["value"] for x in V.report(V.confusion(df)).collect()}
    assert r["accuracy"] == 0.5 and math.isclose(r["balanced_accuracy"], 0.5) and math.isclose(r["macro_recall"], 0.5) and math.isclose(r["macro_precision"], 4 / 9)


def test_auc_with_ties(spark):
    rows = [(1, 1, 1, 0.5), (1, 1, 0, 0.5), (2, 0, 1, 0.5), (2, 0, 0, 0.5)]
    df = spark.createDataFrame(rows, "key int, y int, label int, p double")
    assert {r["average"]: r["auc"] for r in V.auc_one_vs_rest(df).collect()} == {"macro": 0.5, "weighted": 0.5, "micro": 0.5}


def test_composite_skips_tables_with_few_groups(spark):
    columns = [c for g in D.GROUPS.values() for c in g]
    full, few = [float(i) for i in range(10)], [1.0, 2.0] + [None] * 8
    other = [float(10 - i) for i in range(10)]
    df = spark.createDataFrame([("t", *full), ("u", *few), ("v", *other)], "dataset_id string, " + ", ".join(f"{c} double" for c in columns))
    rows = {r["dataset_id"]: r["difficulty"] for r in D.composite(df).collect()}
    assert set(rows) == {"t", "v"} and all(0 <= x <= 1 for x in rows.values())


def test_validation_marks_missing_and_nan(spark):
    got = spark.createDataFrame([("m", "a", 1.0), ("m", "b", float("nan"))], "metric string, sub_metric string, value double")
    want = spark.createDataFrame([("m", "a"), ("m", "b"), ("m", "c")], "metric string, sub_metric string")
    assert {r["sub_metric"]: r["status"] for r in X.validated(got, want).collect()} == {"a": "ok", "b": "nan", "c": "missing"}


def test_ranks_and_quantiles_are_exact_over_parts(spark):
    import random

    from tablegauge.operators.ordering import hash_ranked, quantiles, running_before

    rnd = random.Random(3)
    rows = [(k, rnd.choice(["a", "a", "a", "b", None]), rnd.choice([0.0, 1.5, rnd.random() * 100])) for k in range(70_000)] + [(None, "c", 5.0), (-1, "c", None)]
    df = spark.createDataFrame(rows, "k long, label string, x double")
    own = hash_ranked(df, F.md5(F.col("k").cast("string")), "k", "label", size="size")
    want = df.withColumn("h", F.md5(F.col("k").cast("string"))).selectExpr("k", "row_number() over (partition by label order by h, k) as r", "count(*) over (partition by label) as s")
    assert own.select("k", "rank", "size").exceptAll(want).count() == 0 and own.count() == len(rows)
    shares = [0.0, 0.1, 0.25, 0.5, 0.999, 1.0]
    got = {r["label"]: r["q"] for r in quantiles(df, ["x"], shares, "label").collect()}
    exact = {r["label"]: r["q"] for r in df.groupBy("label").agg(F.percentile("x", F.array(*map(F.lit, shares))).alias("q")).collect()}
    assert got.keys() == exact.keys() and all(abs(a - b) < 1e-9 for k in got for a, b in zip(got[k], exact[k]))
    cells = df.where("x is not null").groupBy("label", "x").agg(F.count("*").alias("n"))
    before = running_before(cells, "x", "n", "label")
    plain = cells.selectExpr("label", "x", "n", "coalesce(sum(n) over (partition by label order by x rows between unbounded preceding and 1 preceding), 0) as before")
    assert before.exceptAll(plain).count() == 0 and before.count() == cells.count()


def test_a_failing_metric_is_a_row(spark):
    df = spark.createDataFrame([(k, k % 2, float(k), float(k * k % 7)) for k in range(60)], "k long, y int, a double, b double")
    got = {(r["metric"], r["sub_metric"]): r for r in X.measured(df, "y", ["a", "b"], "k").collect()}
    assert len({m for m, _ in got}) == 10 and all(r["status"] == "ok" for r in got.values())
    bad = X.measured(df, "y", ["a", "absent"], "k", ["anova_f", "nothing"]).collect()
    assert [(r["metric"], r["status"], r["value"]) for r in bad] == [("anova_f", "error", None), ("nothing", "error", None)] and all(r["message"] for r in bad)


def test_text_columns_refuse_unknown_modes(spark):
    from tablegauge.operators import encode

    x = spark.createDataFrame([(1, "b"), (2, None), (3, "a")], "k int, t string")
    assert [r["t"] for r in encode.text_columns(x).orderBy("k").collect()] == [1, None, 0]
    assert encode.text_columns(x, "keep").columns == ["k", "t"] and encode.text_columns(x, "drop").columns == ["k"]
    with pytest.raises(ValueError, match="no mode"):
        encode.text_columns(x, "other")


def test_cleaning_modes(spark):
    from tablegauge.plans import pipelines

    x = spark.range(40).selectExpr("int(id % 2) as y", "concat('t', id % 4) as t", "case when id % 4 < 2 then 80 else 22 end as dst_port", "id % 8 / 3.0D as v", "id % 4 * 1000 as n")
    got = pipelines.cleaned(x, "y", text="encode", bins=4)
    assert dict(got.dtypes)["V"] == "string" and got.columns[-1] == "y" and 1 < got.select("V").distinct().count() <= 4
    assert got.select("DST_PORT").distinct().count() == 2
    plain = pipelines.cleaned(x, "y", numbers="keep", text="drop", digits=None, ports=False)
    assert "T" not in plain.columns and dict(plain.dtypes)["N"] == "bigint" and dict(plain.dtypes)["DST_PORT"] == "int"
    with pytest.raises(ValueError, match="no mode"):
        pipelines.cleaned(x, "y", text="other")
