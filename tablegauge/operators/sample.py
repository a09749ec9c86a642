"""Samples, splits and class balancing, in the reproducible order of a hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import hash_key, hash_share
from ..functions.stored import stored
from .ordering import hash_ranked


def fraction_sample(df: DataFrame, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """Rows whose hash falls below the fraction; larger fractions hold smaller ones."""
    return df.where(hash_share(F.col(key), seed) < fraction)


def ranked(df: DataFrame, label: str, key: str, seed: int = 42, out: str = "rank") -> DataFrame:
    """Rows numbered from 1 within their class by hash."""
    return hash_ranked(df, hash_key(F.col(key), seed), key, label, out=out)


def _sized(df: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    return hash_ranked(df, hash_key(F.col(key), seed), key, label, size="size")


def draws(df: DataFrame, label: str, key: str, wanted: DataFrame, seed: int = 42) -> DataFrame:
    """Rows drawn with replacement: ``wanted(label, n)`` of each class, with a ``draw`` number.

    A draw takes the row whose rank is a hash of the draw's number, so it is an equi join.
    """
    sizes = df.groupBy(label).agg(F.count("*").alias("size"))
    plan = wanted.where("n > 0").join(sizes, label).select(label, "size", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n").cast("bigint"))).alias("draw"))
    pick = F.floor(hash_share(F.concat(F.col(label).cast("string"), F.lit("|"), F.col("draw").cast("string")), seed) * F.col("size")) + 1
    return plan.select(label, "draw", pick.cast("bigint").alias("rank")).join(ranked(df, label, key, seed), [label, "rank"]).select(*df.columns, "draw")


def oversample_min(df: DataFrame, label: str, key: str, least: int, seed: int = 42) -> DataFrame:
    """Classes under ``least`` rows get ``least`` more, drawn with replacement; ``draw`` is 0 for originals."""
    wanted = df.groupBy(label).agg(F.count("*").alias("size")).where(F.col("size") < least).select(label, F.lit(least).alias("n"))
    return df.withColumn("draw", F.lit(0).cast("bigint")).unionByName(draws(df, label, key, wanted, seed))


def budget_allocation(df: DataFrame, label: str, budget: int, floor: int) -> DataFrame:
    """Rows of each class under a budget: its share, at least ``floor``, rescaled once, never more than it has."""
    counts = df.groupBy(label).agg(F.count("*").alias("size"))
    total = F.sum("size").over(Window.partitionBy())
    first = counts.withColumn("want", F.least(F.greatest(F.floor(F.col("size") * budget / total), F.lit(floor)), F.col("size")))
    scale = F.least(F.lit(1.0), F.lit(float(budget)) / F.sum("want").over(Window.partitionBy()))
    return first.withColumn("n", F.least(F.greatest(F.floor(F.col("want") * scale), F.lit(floor)), F.col("size")).cast("bigint")).select(label, "size", "n")


def stratified_budget(df: DataFrame, label: str, key: str, budget: int, floor: int, seed: int = 42) -> DataFrame:
    """A stratified sample of a row budget."""
    plan = budget_allocation(df, label, budget, floor).select(label, "n")
    return ranked(df, label, key, seed).join(plan, label).where("rank <= n").select(*df.columns)


def fraction_ladder(df: DataFrame, key: str, fractions: list[float], seed: int = 42) -> DataFrame:
    """Each row once for every fraction whose sample holds it: ``fraction`` first."""
    held = F.filter(F.array(*[F.lit(f) for f in fractions]), lambda f: hash_share(F.col(key), seed) < f)
    return df.select(F.explode(held).alias("fraction"), *df.columns)


def stratified_split(df: DataFrame, label: str, key: str, train: float = 0.6, validation: float = 0.2, seed: int = 42) -> DataFrame:
    """``subset`` of every row: disjoint, each class in proportion, and in every subset if it has five rows."""
    at = (F.col("rank") - 1) / F.col("size")
    cut = F.when(at < train, "train").when(at < train + validation, "validation").otherwise("test")
    return _sized(df, label, key, seed).withColumn("subset", cut).select(*df.columns, "subset")


def downsample(df: DataFrame, label: str, key: str, rate: float, least: int, seed: int = 42) -> DataFrame:
    """Per class, the greater of ``least`` and its share of rows (all, where it has fewer)."""
    return _sized(df, label, key, seed).where(F.col("rank") <= F.greatest(F.lit(least), F.floor(F.col("size") * rate))).select(*df.columns)


def hash_split(df: DataFrame, key: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    """A train / test flag by hash alone."""
    return df.withColumn("subset", F.when(hash_share(F.col(key), seed) < test, "test").otherwise("train"))


def balance_targets(df: DataFrame, label: str, threshold: float | None, over: bool) -> DataFrame:
    """Rows to add (over) or to keep (under) per class; ``None`` balances to the mean class size."""
    counts = df.groupBy(label).agg(F.count("*").alias("size"))
    fair = F.floor(F.sum("size").over(Window.partitionBy()) / F.count("*").over(Window.partitionBy()))
    if over:
        short = F.greatest(fair - F.col("size"), F.lit(0))
        n = short if threshold is None else F.least(F.floor(F.col("size") * threshold), short)
    else:
        n = F.least(F.col("size"), fair) if threshold is None else F.greatest(F.least(F.col("size"), fair), F.floor(F.col("size") * (1 - threshold)))
    return counts.select(label, "size", n.cast("bigint").alias("n"))


def resample(df: DataFrame, label: str, key: str, targets: DataFrame, seed: int = 42) -> DataFrame:
    """Rows so that each class has ``targets(label, total)``: kept by rank, then drawn; 0 drops a class."""
    plan = targets.select(label, "total")
    kept = ranked(df, label, key, seed).join(plan, label).where("rank <= total").select(*df.columns, F.lit(0).cast("bigint").alias("draw"))
    sizes = df.groupBy(label).agg(F.count("*").alias("size"))
    more = plan.join(sizes, label).select(label, F.greatest(F.col("total") - F.col("size"), F.lit(0)).alias("n"))
    return kept.unionByName(draws(df, label, key, more, seed))


def over_then_under(df: DataFrame, label: str, key: str, over: float | None, under: float | None, seed: int = 42) -> DataFrame:
    """Oversampling to its targets, then undersampling to its own; ``discarded`` deletes the written table it reads."""
    grown = stored(resample(df, label, key, balance_targets(df, label, over, True).select(label, (F.col("size") + F.col("n")).alias("total")), seed), "oversampled")
    targets = balance_targets(grown, label, under, False).select(label, F.col("n").alias("total"))
    keyed = grown.withColumn("__key", F.concat_ws("|", F.col(key).cast("string"), F.col("draw").cast("string")))
    out = ranked(keyed, label, "__key", seed).join(targets, label).where("rank <= total").select(*grown.columns)
    out.stored_at = grown.stored_at
    return out


def folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """A ``fold`` from 0 for every row, dealt out within each class."""
    return ranked(df, label, key, seed).withColumn("fold", (F.col("rank") % k).cast("int")).select(*df.columns, "fold")


def bootstrap(df: DataFrame, key: str, replicates: int, seed: int = 42) -> DataFrame:
    """``replicate`` and rows drawn with replacement, as many as there are."""
    numbered = hash_ranked(df, hash_key(F.col(key), seed), key)
    n = df.agg(F.count("*").alias("size"))
    slots = numbered.select(F.col("rank").alias("slot")).crossJoin(F.broadcast(n)).select("size", "slot", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    pick = F.floor(hash_share(F.concat(F.col("replicate").cast("string"), F.lit("|"), F.col("slot").cast("string")), seed) * F.col("size")) + 1
    return slots.select("replicate", "slot", pick.cast("bigint").alias("rank")).join(numbered, "rank").drop("rank")
