"""Sinks: tables, sidecars, mappings, and publishing to a next stage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import round_half_even
from ..operators.clean import columns_of
from ..operators.encode import label_codes, value_counts
from ..operators.profile import column_profile


def save(df: DataFrame, path: str, formats: tuple[str, ...] = ("parquet",), target: str | None = None) -> None:
    """Write a table as Parquet and/or CSV, and with a target its sidecar tables."""
    for f in formats:
        writer = df.write.mode("overwrite")
        writer.option("header", True).csv(f"{path}/csv") if f == "csv" else writer.parquet(f"{path}/parquet")
    if target:
        sidecar(df, path, target)


def sidecar(df: DataFrame, path: str, target: str) -> None:
    """``columns`` and ``label_counts`` tables beside a table."""
    column_profile(df).write.mode("overwrite").parquet(f"{path}/columns")
    value_counts(df, target).write.mode("overwrite").parquet(f"{path}/label_counts")


def save_rounded(df: DataFrame, path: str, subset: str = "subset", digits: int = 3) -> None:
    """Write subsets as partitions, decimals rounded half to even."""
    floats = set(columns_of(df, "float"))
    rounded = df.select(*[round_half_even(F.col(c), digits).alias(c) if c in floats else F.col(c) for c in df.columns])
    rounded.write.mode("overwrite").partitionBy(subset).parquet(path)


def save_mappings(df: DataFrame, columns: list[str], path: str) -> None:
    """``column, value, code`` of several columns' codes."""
    for k, c in enumerate(columns):
        codes = label_codes(df, c).select(F.lit(c).alias("column"), F.col("value").cast("string").alias("value"), "code")
        codes.write.mode("append" if k else "overwrite").parquet(path)


def publish(df: DataFrame, path: str, *by: str) -> None:
    """Replace just the partitions that ``df`` holds in the input of a next stage."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
