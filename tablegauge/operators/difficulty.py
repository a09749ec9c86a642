"""Composite difficulty of many tables from their metrics, in one grouped job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The five groups, two metrics each.
GROUPS = {
    "Feature_Relevance": ("anova_f_mean", "mutual_info_mean"),
    "Local_Overlap": ("pca_centroid_distance_pca_centroid_score", "mahalanobis_class_distance_mean"),
    "Boundary_Hardness": ("svm_margin_mean", "class_proba_entropy_mean"),
    "Global_Structure": ("intrinsic_dimensionality_intrinsic_dimensionality_percent", "calinski_harabasz_calinski_harabasz_score"),
    "Class_Distribution_Separation": ("class_confusion_entropy_confusion_entropy", "class_imbalance_normalized_entropy"),
}
# Metrics that fall as tables get harder, so their sign is turned.
INVERTED = ("anova_f_mean", "mutual_info_mean", "svm_margin_mean", "mahalanobis_class_distance_mean", "calinski_harabasz_calinski_harabasz_score", "class_imbalance_normalized_entropy")
#: Turned only on request: published scores leave it as it is.
ALSO_INVERTED = ("pca_centroid_distance_pca_centroid_score",)


def flattened(df: DataFrame, metrics: str, *keys: str) -> DataFrame:
    """``keys, name, value`` of a map of maps."""
    outer = df.select(*keys, F.explode(metrics).alias("metric", "inner"))
    return outer.select(*keys, "metric", F.explode("inner").alias("sub", "value")).select(*keys, F.concat_ws("_", "metric", "sub").alias("name"), "value")


def wide(flat: DataFrame, names: list[str], *keys: str) -> DataFrame:
    """A column for each name."""
    return flat.groupBy(*keys).pivot("name", names).agg(F.first("value"))


def available(df: DataFrame, groups: dict[str, tuple[str, ...]] | None = None, least_groups: int = 3) -> DataFrame:
    """``n_metrics, n_groups, usable``: a metric at least in enough groups."""
    groups = groups or GROUPS
    there = lambda c: (F.col(c).isNotNull() & ~F.isnan(c)).cast("int")
    n = sum((there(c) for g in groups.values() for c in g), F.lit(0))
    k = sum((F.greatest(F.lit(0), *[there(c) for c in g]) for g in groups.values()), F.lit(0))
    return df.withColumns({"n_metrics": n, "n_groups": k, "usable": k >= least_groups})


def unit_interval(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns scaled over all rows to 0..1, nulls as 0 before; a constant one is 0."""
    w = Window.partitionBy()  # a row per table: a small result table
    filled = df.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(0.0)) for c in columns})
    return filled.withColumns({c: F.when(F.max(c).over(w) > F.min(c).over(w), (F.col(c) - F.min(c).over(w)) / (F.max(c).over(w) - F.min(c).over(w))).otherwise(0.0) for c in columns})


def composite(df: DataFrame, groups: dict[str, tuple[str, ...]] | None = None, inverted: tuple[str, ...] = INVERTED, exclude: tuple[str, ...] = (), key: str = "dataset_id") -> DataFrame:
    """Group difficulties, the means of their metrics, and ``difficulty``, the mean of groups."""
    groups = groups or GROUPS
    columns = [c for g in groups.values() for c in g]
    for word in exclude:
        df = df.where(~F.col(key).contains(word))
    turned = available(df, groups).where("usable").withColumns({c: -F.col(c) for c in columns if c in inverted})
    scaled = unit_interval(turned, columns)
    means = {f"difficulty_{g}": sum((F.col(c) for c in cs), F.lit(0.0)) / len(cs) for g, cs in groups.items()}
    out = scaled.withColumns(means)
    return out.withColumn("difficulty", sum((F.col(c) for c in means), F.lit(0.0)) / len(means)).select(key, *means, "difficulty")


def ordered(df: DataFrame, order: DataFrame, key: str = "dataset_id") -> DataFrame:
    """Rows of a fixed list ``(key, position)``, in its order."""
    return df.join(order, key).orderBy("position")
