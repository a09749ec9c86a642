"""Projections, filters and set operations on tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import quantiles
from pyspark.sql import types as T

from ..functions.scalars import slug

NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def columns_of(df: DataFrame, kind: str) -> list[str]:
    """Names of the ``number``, ``float``, ``text`` or ``other`` columns."""
    kinds = {"number": NUMBERS, "float": (T.FloatType, T.DoubleType), "text": (T.StringType,)}
    if kind == "other":
        return [f.name for f in df.schema if not isinstance(f.dataType, NUMBERS + (T.StringType,))]
    return [f.name for f in df.schema if isinstance(f.dataType, kinds[kind])]


def rightmost(df: DataFrame, *last: str) -> DataFrame:
    """Named columns moved to the right end, those missing ignored."""
    end = [c for c in last if c in df.columns]
    return df.select(*[c for c in df.columns if c not in end], *end)


def normalized_columns(df: DataFrame, target: str) -> DataFrame:
    """Feature names upper-case with underscores, numbered where they would clash; target last."""
    taken: set[str] = {target.upper()}
    out = []
    for c in df.columns:
        if c == target:
            continue
        name = base = "".join(x if x.isascii() and x.isalnum() else "_" for x in c).upper()
        k = 1
        while name in taken:
            k += 1
            name = f"{base}_{k}"
        taken.add(name)
        out.append(F.col(f"`{c}`").alias(name))
    return df.select(*out, F.col(f"`{target}`"))


def trimmed_names(df: DataFrame) -> DataFrame:
    """White space around column names removed."""
    return df.toDF(*[c.strip() for c in df.columns])


def long_form(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """``keys, feature, value``: one row per row and feature."""
    return df.select(*keys, *[F.col(c).cast("double") for c in features]).unpivot(keys, features, "feature", "value")


def drop_infinite(df: DataFrame) -> DataFrame:
    """Rows without an infinite value; nulls stay."""
    inf = [F.lit(float("inf")), F.lit(float("-inf"))]
    tests = [F.coalesce(F.col(c).cast("double").isin(*inf), F.lit(False)) for c in columns_of(df, "float")]
    return df.where(~reduce(lambda a, b: a | b, tests)) if tests else df


def infinite_to_null(df: DataFrame) -> DataFrame:
    """NaN and infinite values as null."""
    floats = set(columns_of(df, "float"))
    bad = lambda c: F.isnan(c) | c.isin(float("inf"), float("-inf"))
    return df.select(*[F.when(~bad(F.col(c)), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns])


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Columns that hold a value somewhere, found in one pass."""
    seen = df.agg(*[F.max(F.col(c).isNotNull()).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if seen[c]])


def clean_matrix(df: DataFrame) -> DataFrame:
    """Infinite to null, then empty columns, rows with a null and repeated rows dropped."""
    return drop_empty_columns(infinite_to_null(df)).na.drop("any").dropDuplicates()


def multiplicity(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct rows with the number of times each occurs."""
    return df.groupBy(*(columns or df.columns)).agg(F.count("*").alias("multiplicity"))


def keep_frequent_classes(df: DataFrame, label: str, least_percent: float = 0.01) -> DataFrame:
    """Rows of classes above a relative frequency in percent."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    kept = counts.crossJoin(F.broadcast(total)).where(F.col("n") * 100.0 / F.col("total") > least_percent).select(label)
    return df.join(kept, label, "left_semi")


def keep_by_count_quantile(df: DataFrame, label: str, q: float = 0.05) -> DataFrame:
    """Rows of classes whose count reaches the quantile of class counts."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    cut = quantiles(counts, ["n"], [q]).select(F.col("q")[0].alias("cut"))
    return df.join(counts.crossJoin(F.broadcast(cut)).where("n >= cut").select(label), label, "left_semi")


def row_mean_filter(df: DataFrame, label: str, mean: str, key: str, q: float = 0.1) -> DataFrame:
    """Rows above their class's quantile of ``mean``; a class left empty keeps its best row."""
    best = df.groupBy(label).agg(F.max(F.struct(F.col(mean), F.col(key))).alias("__best"), F.max(mean).alias("__top"))
    cuts = best.join(quantiles(df, [mean], [q], label).select(label, F.col("q")[0].alias("__cut")), label)
    joined = df.join(cuts, label)
    kept = (F.col(mean) > F.col("__cut")) | ((F.col("__top") <= F.col("__cut")) & (F.struct(F.col(mean), F.col(key)) == F.col("__best")))
    return joined.where(kept).select(*df.columns)


def top_by_share(df: DataFrame, name: str, gain: str, share: float = 0.95) -> DataFrame:
    """Rows in falling order of ``gain`` up to the one that crosses the share of the total; none where that is 0."""
    order = Window.orderBy(F.desc(gain), name)
    total = F.nullif(F.sum(gain).over(Window.partitionBy()), F.lit(0.0))
    before = F.coalesce(F.sum(gain).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) / total
    through = F.sum(gain).over(order.rowsBetween(Window.unboundedPreceding, 0)) / total
    return df.withColumn("before", before).withColumn("cumulative", through).where(F.col("before") < share).drop("before")


def union_by_name(*tables: DataFrame) -> DataFrame:
    """Tables of one kind under each other; columns one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def slug_labels(df: DataFrame, label: str) -> DataFrame:
    """Labels with underscores for other characters."""
    return df.withColumn(label, slug(F.col(label)))
