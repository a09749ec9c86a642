"""Jobs over many labelled tables of different columns, as one grouped plan.

Tables become rows of one frame ``dataset_id, key, label, x``, with their features as an array,
so that cleaning, preparation, metrics and difficulty are grouped by the table, whatever
columns it has. Nothing is done table by table.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import hash_share
from ..functions.stored import stored
from . import complexity as X
from . import difficulty as D
from .analysis import correlation_table
from .moments import imbalance


@dataclass(frozen=True)
class Labelled:
    """A table with its label, its features, and a key whose hash orders rows."""

    rows: DataFrame
    key: str
    label: str
    features: tuple[str, ...]


#: The groups of a difficulty that moments and counts of all tables give.
GROUPS = {
    "Feature_Relevance": ("anova_f_mean", "mutual_information_mean"),
    "Global_Structure": ("centroid_distance", "calinski_harabasz"),
    "Class_Distribution": ("normalized_entropy",),
}
INVERTED = ("anova_f_mean", "mutual_information_mean", "calinski_harabasz", "normalized_entropy")


def stacked(tables: dict[str, Labelled]) -> DataFrame:
    """``dataset_id, key, label, x`` of all tables; keys and labels as text, features as doubles."""
    parts = [
        t.rows.select(F.lit(name).alias("dataset_id"), F.col(t.key).cast("string").alias("key"), F.col(t.label).cast("string").alias("label"), F.array(*[F.col(c).cast("double") for c in t.features]).alias("x"))
        for name, t in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def cleaned(rows: DataFrame, fraction: float = 1.0, seed: int = 42) -> DataFrame:
    """Rows without gaps or infinite numbers, those that repeat label and features once, under their least key; then a sample by the key's hash."""
    sound = F.forall("x", lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
    once = rows.where(F.col("label").isNotNull() & F.col("key").isNotNull() & sound).groupBy("dataset_id", "label", "x").agg(F.min("key").alias("key"))
    return once if fraction >= 1 else once.where(hash_share(F.col("key"), seed) < fraction)


def features_of(rows: DataFrame, keyed: bool = True) -> DataFrame:
    """``dataset_id, key, label, feature, value``: a row per row and feature, features by their place; without keys where not ``keyed``."""
    return rows.select("dataset_id", *(["key"] if keyed else []), "label", F.posexplode("x").alias("feature", "value"))


def prepared(rows: DataFrame, few: int = 200, keyed: bool = True) -> DataFrame:
    """``features_of`` the rows, ready for metrics: a feature of under ``few`` values by their share, others standardised; constants are 0.

    The values of few-valued features are counted; of the others only their moments are taken.
    What is known of features and of their few values, fewer than ``few`` rows a feature, is sent to all rows.
    """
    long = stored(features_of(rows, keyed), "many-features")
    names = [c for c in long.columns if c != "value"]
    stats = long.groupBy("dataset_id", "feature").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count_distinct("value").alias("n_distinct"))
    stats = stored(stats, "many-stats")  # a row per table and feature
    counted = stats.where(F.col("n_distinct") < few)
    shares = long.join(F.broadcast(counted.select("dataset_id", "feature", "n")), ["dataset_id", "feature"]).groupBy("dataset_id", "feature", "value", "n").agg((F.count("*") / F.col("n")).alias("share"))
    by_share = long.join(F.broadcast(shares.drop("n")), ["dataset_id", "feature", "value"]).select(*names, F.col("share").alias("value"))
    z = F.when(F.col("std") > 0, (F.col("value") - F.col("mean")) / F.col("std")).otherwise(0.0)
    by_scale = long.join(F.broadcast(stats.where(F.col("n_distinct") >= few)), ["dataset_id", "feature"]).select(*names, z.alias("value"))
    return by_share.unionByName(by_scale)


def metrics(long: DataFrame, bins: int = 32) -> DataFrame:
    """A row per table: ``n_rows, n_features, anova_f_mean, mutual_information_mean, centroid_distance, calinski_harabasz, n_classes, imbalance_ratio, normalized_entropy``."""
    long = stored(long, "many-prepared")
    moments = stored(long.groupBy("dataset_id", "label", "feature").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), (F.var_pop("value") * F.count("*")).alias("m2")), "many-moments")
    span = long.groupBy("dataset_id", "feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0)
    cells = long.join(F.broadcast(span), ["dataset_id", "feature"]).groupBy("dataset_id", "feature", at.alias("bin"), "label").agg(F.count("*").alias("n"))
    one = cells.select(F.concat_ws("|", F.col("feature").cast("string"), "dataset_id").alias("feature"), "bin", "label", "n")
    information = X.mutual_information(one).select(F.regexp_extract("feature", r"(?s)^\d+\|(.*)$", 1).alias("dataset_id"), "mutual_information").groupBy("dataset_id").agg(F.avg("mutual_information").alias("mutual_information_mean"))
    size = moments.groupBy("dataset_id").agg((F.sum("n") / F.count_distinct("feature")).cast("long").alias("n_rows"), F.count_distinct("feature").alias("n_features"))
    relevance = X.anova_f(moments, "dataset_id").groupBy("dataset_id").agg(F.avg("f").alias("anova_f_mean"))
    classes = moments.groupBy("dataset_id", "label").agg(F.max("n").alias("n"))
    out = size
    for other in (relevance, information, X.centroid_distance(moments, "dataset_id"), X.calinski_harabasz(moments, "dataset_id"), imbalance(classes, "dataset_id")):
        out = out.join(other, "dataset_id", "left")
    return out


def difficulty(found: DataFrame) -> DataFrame:
    """``dataset_id``, the groups' difficulties and ``difficulty``, of tables compared with each other."""
    return D.composite(found, GROUPS, INVERTED)


def related(found: DataFrame, results: DataFrame, scores: list[str], *by: str) -> DataFrame:
    """``by, metric, pearson, spearman, kendall`` of scores with the difficulty of their table.

    ``results`` has ``dataset_id``, the scores and ``by``, in any number of rows a table.
    """
    return correlation_table(results.join(found.select("dataset_id", "difficulty"), "dataset_id"), scores, "difficulty", *by)
