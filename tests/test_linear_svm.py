"""Linear support-vector machines against MLlib's and known optima, and the jobs they take."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablegauge.operators import complexity as X
from tablegauge.operators import linear_svm as L


def blocks(df):
    return L.packed(df.select(F.col("y").cast("double").alias("y"), F.array("a", "b").alias("x"))).cache()


def loss(data, c, w):
    """The mean hinge with the penalty of C = 1."""
    x, sign = data[:, 1:], np.where(data[:, 0] == c, 1.0, -1.0)
    return np.maximum(0, 1 - sign * (x @ w[:-1] + w[-1])).mean() + w[:-1] @ w[:-1] / (2 * len(x))


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(50, 10, 6000), rng.normal(5e4, 3e4, 6000)
    y = ((a - 50) / 10 + (b - 5e4) / 6e4 + rng.normal(0, 0.8, 6000) > 0.3) * 1 + (rng.random(6000) < 0.3)
    return np.c_[y, a, b], spark.createDataFrame([(int(k), float(p), float(q)) for k, p, q in zip(y, a, b)], "y int, a double, b double").repartition(3)


def test_no_machine_is_worse_than_mllibs(table):
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.feature import VectorAssembler

    data, df = table
    got = L.fitted(blocks(df))
    assert sorted(got) == [0, 1, 2]
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    for c, w in got.items():
        model = LinearSVC(regParam=1.0 / len(data), standardization=False, maxIter=10).fit(rows.withColumn("label", (F.col("y") == c).cast("double")))
        assert loss(data, c, w) <= loss(data, c, np.r_[model.coefficients.toArray(), model.intercept]) + 1e-5


def test_two_classes_one_class_constant_columns_and_none(spark):
    df = spark.createDataFrame([(k % 2, float(k % 2), 7.0) for k in range(40)], "y int, a double, b double")
    (c, w), = L.fitted(blocks(df)).items()
    assert c == 1 and w[1] == 0 and abs(w[0] - 2) < 1e-3 and abs(w[2] + 1) < 1e-3  # a margin of 1 on both sides
    assert abs(X.svm_margin(df, "y", ["a", "b"]).first()["mean"] - 1) < 1e-3
    assert abs(X.svm_margin(df.where("y = 0"), "y", ["a", "b"], signed=True).first()["max"] + 1) < 1e-3
    with pytest.raises(ValueError):
        L.fitted(blocks(df.where("false")))


def test_labels_that_no_column_tells_take_few_jobs(spark):
    """MLlib's line searches took hundreds of passes here."""
    df = spark.range(4000).selectExpr("id * 7919 % 3 as y", "double(id * 31 % 101) as a", "double(id * 77 % 1009) * 90 as b")
    spark.sparkContext.setJobGroup("svm", "")
    got = X.svm_margin(df, "y", ["a", "b"]).first()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("svm"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert abs(got["min"] - 1) < 1e-3 and abs(got["max"] - 1) < 1e-3
    assert jobs < 150
