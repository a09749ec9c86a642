"""Second moments of many columns by class: matrix products of Arrow batches, summed by Spark.

A task adds up the products of its rows class by class and hands on one number for each
class and pair of columns, so that what is shuffled does not depend on its rows, and no
expression grows with the square of the columns.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Bytes of sums that a task holds before it hands them on.
HELD = 1 << 26


def class_means(df: DataFrame, label: str, features: list[str]) -> dict:
    """Mean of every column for each class, as arrays; a column without values has NaN."""
    rows = df.groupBy(F.col(f"`{label}`").alias("label")).agg(*[F.avg(F.col(f"`{c}`").cast("double")).alias(f"m{i}") for i, c in enumerate(features)]).collect()  # a row per class
    return {r["label"]: np.array([np.nan if v is None else v for v in r[1:]], float) for r in rows}


def _numbers(df: DataFrame, label: str, features: list[str]) -> DataFrame:
    """``label`` and the columns as doubles under names of their own."""
    return df.select(F.col(f"`{label}`").alias("label"), *[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(features)])


def _batch(batch: pa.RecordBatch, p: int) -> tuple[np.ndarray, np.ndarray, list]:
    """Values with 0 for null, which are there, and the rows of each label."""
    columns = [batch.column(f"x{i}") for i in range(p)]
    there = np.stack([pc.is_valid(c).to_numpy(zero_copy_only=False) for c in columns], axis=1)
    x = np.stack([pc.fill_null(c, 0.0).to_numpy(zero_copy_only=False) for c in columns], axis=1)
    codes = batch.column("label").dictionary_encode()
    index = pc.fill_null(codes.indices, -1).to_numpy(zero_copy_only=False)
    names = codes.dictionary.to_pylist()
    return x, there, [(None if k < 0 else names[k], np.flatnonzero(index == k)) for k in np.unique(index).tolist()]


def pair_sums(df: DataFrame, label: str, features: list[str], means: dict) -> DataFrame:
    """``label, a, b, n, sa, sb, g`` for the places ``a <= b`` of the columns, over the rows that have both.

    ``sa`` and ``sb`` are the sums, ``g`` the sum of products, of the values less their class's mean.
    """
    rows = _numbers(df, label, features)
    p = len(features)
    held_means = df.sparkSession.sparkContext.broadcast(means)  # classes times columns
    label_type = to_arrow_type(rows.schema["label"].dataType)
    low, high = np.triu_indices(p)
    names = ["label", "a", "b", "n", "sa", "sb", "g"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}

        def out() -> Iterator[pa.RecordBatch]:
            for k, (n, s, g) in sums.items():
                one = [pa.array([k] * len(low), label_type), pa.array(low, pa.int32()), pa.array(high, pa.int32())]
                yield pa.RecordBatch.from_arrays([*one, pa.array(n[low, high].astype(np.int64)), pa.array(s[low, high]), pa.array(s[high, low]), pa.array(g[low, high])], names)

        for batch in batches:
            x, there, groups = _batch(batch, p)
            for k, at in groups:
                seen = there[at]
                d = np.where(seen, x[at] - held_means.value[k], 0.0)
                m = seen.astype(float)
                more = m.T @ m, d.T @ m, d.T @ d  # rows that have both; sums of a where b is there; products
                sums[k] = tuple(a + b for a, b in zip(sums[k], more, strict=True)) if k in sums else more
            if len(sums) * 24 * p * p > HELD:
                yield from out()
                sums = {}
        yield from out()

    kind = rows.schema["label"].dataType.simpleString()
    parts = rows.mapInArrow(run, f"label {kind}, a int, b int, n long, sa double, sb double, g double")
    return parts.groupBy("label", "a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "g")])


def covariances(df: DataFrame, label: str, features: list[str], means: dict | None = None) -> DataFrame:
    """``label, a, b, covariance`` for the places ``a <= b``; sample normalisation, null for fewer than two rows with both."""
    sums = pair_sums(df, label, features, class_means(df, label, features) if means is None else means)
    value = (F.col("g") - F.col("sa") * F.col("sb") / F.col("n")) / (F.col("n") - 1)
    return sums.select("label", "a", "b", F.when(F.col("n") > 1, value).alias("covariance"))


def quadratic(df: DataFrame, label: str, features: list[str], means: dict, matrices: dict, out: str = "x") -> DataFrame:
    """``label, out``: the root of each row's ``d' M d``, ``d`` its distance from its class's mean; null where a value is."""
    rows = _numbers(df, label, features)
    p = len(features)
    held = df.sparkSession.sparkContext.broadcast((means, matrices))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, shape = held.value
        for batch in batches:
            x, there, groups = _batch(batch, p)
            value = np.zeros(len(x))
            for k, at in groups:
                d = x[at] - centre[k]
                value[at] = np.sqrt(np.maximum(np.einsum("ij,ij->i", d @ shape[k], d), 0.0))
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(value, mask=~there.all(axis=1))], ["label", out])

    return rows.mapInArrow(run, f"label {rows.schema['label'].dataType.simpleString()}, {out} double")
