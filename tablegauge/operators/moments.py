"""Summaries, class moments, covariance and histograms: what the metrics are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .gram import covariances
from .ordering import quantiles


def describe(df: DataFrame, features: list[str]) -> DataFrame:
    """``feature`` with count, mean, sample deviation, exact quartiles and range."""
    row = df.agg(*[
        F.struct(
            F.lit(c).alias("feature"), F.count(c).alias("n"), F.round(F.avg(c), 6).alias("mean"), F.round(F.stddev_samp(c), 6).alias("std"), F.min(c).cast("double").alias("least"), F.max(c).cast("double").alias("most"),
        ).alias(c)
        for c in features
    ])
    one = row.select(F.explode(F.array(*features)).alias("x")).select("x.*")
    cuts = quantiles(df, features, [0.25, 0.5, 0.75]).select("feature", *[F.col("q")[i].alias(k) for i, k in enumerate(("q1", "median", "q3"))])
    return one.join(cuts, "feature", "left").select("feature", "n", "mean", "std", "least", "q1", "median", "q3", "most")


def summary(df: DataFrame, x: str, *by: str) -> DataFrame:
    """Ten statistics of a column, per group if any: population deviation and variance, exact quartiles."""
    own = df.select(*by, F.col(x).cast("double").alias("__x"))
    plain = own.groupBy(*by).agg(F.count("__x").alias("size"), F.max("__x").alias("max"), F.min("__x").alias("min"), F.avg("__x").alias("mean"), F.stddev_pop("__x").alias("std"), F.var_pop("__x").alias("variance"))
    cuts = quantiles(own, ["__x"], [0.25, 0.5, 0.75], *by).drop("feature")
    both = joined_by(plain, cuts, *by)
    q = F.col("q")
    return both.select(*by, "size", "max", "min", "mean", q[1].alias("median"), q[0].alias("q1"), q[2].alias("q3"), (q[2] - q[0]).alias("iqr"), "std", "variance")


def joined_by(rows: DataFrame, few: DataFrame, *by: str) -> DataFrame:
    """``rows`` with the columns of ``few``, which has at most one row a group, or one row in all."""
    if not by:
        return rows.join(F.broadcast(few), F.lit(True), "left")
    other = few.toDF(*[f"__few_{c}" if c in by else c for c in few.columns])
    met = F.lit(True)
    for c in by:
        met = met & F.col(c).eqNullSafe(F.col(f"__few_{c}"))
    return rows.join(other, met, "left").drop(*[f"__few_{c}" for c in by])


def class_moments(df: DataFrame, label: str, features: list[str], *by: str) -> DataFrame:
    """``by, label, feature, n, mean, m2``: one pass that five metrics share."""
    wide = df.groupBy(*by, F.col(label).alias("label")).agg(*[F.struct(F.lit(c).alias("feature"), F.count(c).alias("n"), F.avg(c).alias("mean"), (F.var_pop(c) * F.count(c)).alias("m2")).alias(c) for c in features])
    return wide.select(*by, "label", F.explode(F.array(*features)).alias("x")).select(*by, "label", "x.*")


def array_moments(df: DataFrame, label: str, vector: str, *by: str) -> DataFrame:
    """The same for a vector column: ``feature`` is the position."""
    long = df.select(*by, F.col(label).alias("label"), F.posexplode(vector).alias("feature", "x"))
    x = F.col("x").cast("double")
    return long.groupBy(*by, "label", "feature").agg(F.count("x").alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count("x")).alias("m2"))


def class_covariance(df: DataFrame, label: str, features: list[str]) -> DataFrame:
    """``label, a, b, covariance`` of the feature pairs, sample normalisation; for tables of many columns, too."""
    name = lambda c: F.element_at(F.array(*[F.lit(f) for f in features]), F.col(c) + 1).alias(c)
    return covariances(df, label, features).select("label", name("a"), name("b"), "covariance")


def histogram(df: DataFrame, label: str, features: list[str], bins: int) -> DataFrame:
    """``feature, bin, label, n``: equal-width bins over each feature's range."""
    span = df.agg(*[F.struct(F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi")).alias(c) for c in features])
    joined = df.select(F.col(label).alias("label"), *[F.col(c).cast("double").alias(f"v_{c}") for c in features]).crossJoin(F.broadcast(span))

    def at(c: str) -> Column:
        v, lo, hi = F.col(f"v_{c}"), F.col(c)["lo"], F.col(c)["hi"]
        return F.when(hi > lo, F.least(F.floor((v - lo) / (hi - lo) * bins), F.lit(bins - 1))).otherwise(0).cast("int")

    cells = F.array(*[F.struct(F.lit(c).alias("feature"), at(c).alias("bin")) for c in features])
    return joined.select("label", F.explode(cells).alias("x")).groupBy("x.feature", "x.bin", "label").agg(F.count("*").alias("n"))


def class_counts(df: DataFrame, label: str, *by: str) -> DataFrame:
    """``by, label, n``."""
    return df.groupBy(*by, F.col(label).alias("label")).agg(F.count("*").alias("n"))


def imbalance(counts: DataFrame, *by: str) -> DataFrame:
    """Classes, ratio of the largest to the smallest, normalised entropy (1 for one class)."""
    w = Window.partitionBy(*by)
    p = F.col("n") / F.sum("n").over(w)
    out = counts.withColumn("p", p).groupBy(*by).agg(F.count("*").alias("n_classes"), (F.max("n") / F.min("n")).alias("imbalance_ratio"), F.sum(-F.col("p") * F.log("p")).alias("h"))
    return out.select(*by, "n_classes", "imbalance_ratio", F.when(F.col("n_classes") > 1, F.col("h") / F.log("n_classes")).otherwise(1.0).alias("normalized_entropy"))
