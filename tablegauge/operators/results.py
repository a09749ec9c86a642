"""Comparing, ordering and joining tables of classes, stages and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .profile import column_profile


def absent(df: DataFrame, kept: DataFrame, column: str) -> DataFrame:
    """Values of a column that ``kept`` has lost, each once; a null counts as no value."""
    return df.where(F.col(column).isNotNull()).select(column).distinct().join(kept.select(column).distinct(), column, "left_anti")


def same_values(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """``only_left, only_right, equal``: whether two tables hold the same set of values in a column."""
    sides = absent(a, b, column).select(F.lit(1).alias("left")).unionByName(absent(b, a, column).select(F.lit(0).alias("left")))
    counts = sides.agg(F.count(F.when(F.col("left") == 1, 1)).alias("only_left"), F.count(F.when(F.col("left") == 0, 1)).alias("only_right"))
    return counts.withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def top(df: DataFrame, by: str, key: str, n: int) -> DataFrame:
    """The ``n`` rows of the largest ``by``, ties by the smaller ``key``, with their ``position`` from 1."""
    order = [F.desc_nulls_last(by), F.asc_nulls_last(key)]
    first = df.orderBy(*order).limit(n)
    return first.withColumn("position", F.row_number().over(Window.orderBy(*order)))  # n rows


def stage_columns(stages: dict[str, DataFrame]) -> DataFrame:
    """``stage, column, n_distinct, dtype`` of a table as it goes through the stages of a job."""
    out = None
    for name, df in stages.items():
        part = column_profile(df).select(F.lit(name).alias("stage"), "column", "n_distinct", "dtype")
        out = part if out is None else out.unionByName(part)
    return out


def looked_up(stats: DataFrame, key: str, *others: DataFrame, default: float | None = None) -> DataFrame:
    """Each table's statistics beside its results, by ``key``; what is missing is null, or ``default``.

    Every one of ``others`` has a row a key.
    """
    out, added = stats, []
    for other in others:
        out = out.join(other, key, "left")
        added += [c for c in other.columns if c != key]
    return out if default is None else out.na.fill(default, added)
