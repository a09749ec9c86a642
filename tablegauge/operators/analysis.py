"""Statistics across tables: correlations, densities and their bands."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stored import stored
from .moments import joined_by
from .ordering import running_before
from .sample import bootstrap

#: Ranges that the values of a column are cut into to count inversions.
RANGES = 256


def average_rank(rows: DataFrame, x: str, out: str, *by: str) -> DataFrame:
    """``out``: rank from 1, ties share their mean."""
    cells = rows.groupBy(*by, x).agg(F.count("*").alias("__c"))
    ranks = running_before(cells, x, "__c", *by, out="__b").select(*by, x, (F.col("__b") + (F.col("__c") + 1) / 2).alias(out))
    return joined_by(rows, ranks, *by, x)


def pair_score(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> int:
    """Concordant less discordant pairs of points that occur ``n`` times each; equal ``x`` or ``y`` counts nothing.

    Points are put in the order of ``x`` and told apart by the ranks of ``y``, bit by bit from
    the highest: of two points that first differ in a bit, the one without it is lower.
    """
    if not len(x):
        return 0
    order = np.lexsort((y, x))
    x, n = x[order], n[order].astype(np.int64)
    rank = np.unique(y, return_inverse=True)[1][order]
    place = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    weight, square = np.add.reduceat(n, place), np.add.reduceat(n * n, place)
    score = -int((weight * weight - square).sum()) // 2  # points of one x are counted as concordant below, but those of one y
    start = np.zeros(len(x), np.int64)  # of the points that share all higher bits
    for b in reversed(range(int(rank.max()).bit_length())):
        bit = rank >> b & 1
        ones, zeros = np.r_[0, np.cumsum(n * bit)], np.r_[0, np.cumsum(n * (1 - bit))]
        at = np.arange(len(x))
        score += int((n * np.where(bit > 0, zeros[at] - zeros[start], ones[start] - ones[at])).sum())
        order = np.lexsort((bit, start))  # keeps the order of x
        key = (start * 2 + bit)[order]
        rank, n = rank[order], n[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        start = np.repeat(first, np.diff(np.r_[first, len(key)]))
    return score


def _ranged(cells: DataFrame, c: str) -> DataFrame:
    """``c_part``: which stretch between sampled splitters a value lies in; odd numbers are the splitters themselves."""
    cuts = [k / RANGES for k in range(1, RANGES)]
    edges = cells.groupBy("g").agg(F.array_distinct(F.percentile_approx(c, cuts, F.lit(10 * RANGES))).alias("edges"))
    below = F.size(F.filter("edges", lambda e: e < F.col(c)))
    return joined_by(cells, edges, "g").withColumn(f"{c}_part", (2 * below + F.array_contains("edges", F.col(c)).cast("int")).cast("int")).drop("edges")


def _pair_scores(cells: DataFrame) -> DataFrame:
    """``g, s``: ``pair_score`` of each group of ``cells(g, x, y, n)``, distinct points; no task gets a group.

    Both columns are cut into ranges. Points of different ranges in both are scored from the
    counts of ranges; those of one range of ``y`` among each other by their ranges of ``x``; those
    of one range of ``x`` by their values. A value that is a splitter has a range of its
    own, where all pairs are ties, so none is large.
    """
    cells = stored(_ranged(_ranged(cells, "x"), "y"), "pair-cells")

    def within(x: str, y: str):
        def score(rows: pd.DataFrame) -> pd.DataFrame:
            one = rows.groupby([x, y], as_index=False)["n"].sum()
            return pd.DataFrame({"g": rows["g"].iloc[:1], "s": [pair_score(one[x].to_numpy(), one[y].to_numpy(), one["n"].to_numpy())]})

        return score

    def across(rows: pd.DataFrame) -> pd.DataFrame:
        x, y, n = (rows[c].to_numpy() for c in ("x_part", "y_part", "n"))
        return pd.DataFrame({"g": rows["g"].iloc[:1], "s": [pair_score(x, y, n)]})

    ranges = cells.groupBy("g", "x_part", "y_part").agg(F.sum("n").alias("n"))  # at most (2 RANGES) ** 2 a group
    parts = ranges.groupBy("g").applyInPandas(across, "g string, s long")
    for own, x, y in (("y_part", "x_part", "y"), ("x_part", "x", "y")):
        wide = cells.where(F.col(own) % 2 == 0).select("g", own, x, y, "n")
        parts = parts.unionByName(wide.groupBy("g", own).applyInPandas(within(x, y), "g string, s long"))
    return parts.groupBy("g").agg(F.sum("s").alias("s"))


def correlations(long: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """``by, pearson, spearman, kendall`` of two columns; rows lacking one are left out.

    Kendall's tau-b counts inversions by ranges of both columns, so its work follows the
    distinct pairs; NaN counts as the greatest value.
    """
    group = F.to_json(F.struct(*by)) if by else F.lit("")
    rows = long.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, group.alias("g"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    rows = stored(rows, "correlated")
    ranks = average_rank(average_rank(rows, "x", "rx", "g"), "y", "ry", "g")
    named = [F.first(c).alias(c) for c in by]
    corr = lambda a, b: F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))  # noqa: E731 - null for a constant
    linear = ranks.groupBy("g").agg(*named, corr("x", "y").alias("pearson"), corr("rx", "ry").alias("spearman"))
    cells = stored(rows.groupBy("g", "x", "y").agg(F.count("*").alias("n")), "correlated-pairs")
    pairs = lambda c: cells.groupBy("g", c).agg(F.sum("n").alias("t")).groupBy("g").agg(F.sum(F.col("t") * (F.col("t") - 1) / 2).alias(f"tie_{c}"))
    total = cells.groupBy("g").agg(F.sum("n").alias("m")).select("g", (F.col("m") * (F.col("m") - 1) / 2).alias("all"))
    t = linear.join(total, "g").join(pairs("x"), "g").join(pairs("y"), "g").join(_pair_scores(cells), "g")
    root = F.sqrt((F.col("all") - F.col("tie_x")) * (F.col("all") - F.col("tie_y")))
    return t.select(*by, "pearson", "spearman", F.when(root > 0, F.col("s") / root).alias("kendall"))


def correlation_table(df: DataFrame, scores: list[str], against: str, *by: str) -> DataFrame:
    """The correlations of several score columns with one, stacked."""
    values = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in scores])
    long = df.select(*by, against, F.explode(values).alias("m")).select(*by, against, "m.*")
    return correlations(long, "value", against, "metric", *by)


def grid(df: DataFrame, x: str, points: int, pad: float = 0.0) -> DataFrame:
    """``i, at``: evenly spaced points over a column's range."""
    span = df.agg(F.min(x).cast("double").alias("lo"), F.max(x).cast("double").alias("hi"))
    width = F.col("hi") - F.col("lo")
    return span.select(F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"), "lo", "hi").select("i", (F.col("lo") - pad * width + F.col("i") * width * (1 + 2 * pad) / (points - 1)).alias("at"))


def kde(df: DataFrame, x: str, points: DataFrame, *by: str) -> DataFrame:
    """``by, i, at, density``: Gaussian kernel density at the grid's points, Scott bandwidth.

    The grid, of a stated number of points, is what each row meets.
    """
    rows = df.where(F.col(x).isNotNull()).select(*by, F.col(x).cast("double").alias("x"))
    w = rows.groupBy(*by).agg((F.stddev_samp("x") * F.pow(F.count("*").cast("double"), F.lit(-0.2))).alias("h"))
    sized = rows.join(F.broadcast(w), list(by)) if by else rows.crossJoin(F.broadcast(w))
    met = sized.crossJoin(F.broadcast(points))
    z = F.try_divide(F.col("at") - F.col("x"), "h")  # no density where all values are one
    return met.groupBy(*by, "i", "at").agg((F.sum(F.exp(-0.5 * z * z)) / F.nullif(F.count("*") * F.first("h"), F.lit(0.0)) / 2.5066282746310002).alias("density"))


def kde_band(df: DataFrame, x: str, key: str, points: DataFrame, replicates: int = 1000) -> DataFrame:
    """``i, at, lower, upper``: the central 95 percent of densities of bootstrap replicates."""
    each = kde(bootstrap(df.select(key, x), key, replicates), x, points, "replicate")
    return each.groupBy("i", "at").agg(F.percentile("density", F.lit(0.025)).alias("lower"), F.percentile("density", F.lit(0.975)).alias("upper"))


def kde_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """``i, at, low, high`` of the difference of two bands on one grid: lower minus upper, upper minus lower."""
    b = b.select("i", F.col("lower").alias("bl"), F.col("upper").alias("bu"))
    return a.join(b, "i").select("i", "at", (F.col("lower") - F.col("bu")).alias("low"), (F.col("upper") - F.col("bl")).alias("high"))


def normality_flag(df: DataFrame, x: str, *by: str) -> DataFrame:
    """Skewness and excess kurtosis, the Jarque-Bera statistic, and whether it stays under 5.991."""
    s = df.groupBy(*by).agg(F.count(x).alias("n"), F.skewness(x).alias("skewness"), F.kurtosis(x).alias("kurtosis"))
    jb = F.col("n") / 6 * (F.col("skewness") ** 2 + F.col("kurtosis") ** 2 / 4)
    return s.withColumn("jarque_bera", jb).withColumn("normal", F.col("jarque_bera") < 5.991)
