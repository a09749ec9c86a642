"""Samplers that look at neighbours: synthetic rows and Tomek links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import hash_share
from ..functions.stored import stored
from .encode import label_codes
from .metric_neighbours import nearest
from .sample import ranked


def tomek_links(df: DataFrame, key: str, label: str, vector: str) -> DataFrame:
    """``key, other``: mutual nearest neighbours of different labels, each pair once."""
    near = nearest(df, key, label, vector, 1).where("label <> other_label").select("key", "other")
    back = near.select(F.col("other").alias("key"), F.col("key").alias("other"))
    return near.join(back, ["key", "other"], "left_semi").where("key < other")


def without_tomek(df: DataFrame, key: str, label: str, vector: str) -> DataFrame:
    """Rows without the member of a link whose class is larger (both where they are equal)."""
    counts = df.groupBy(F.col(label).alias("l")).agg(F.count("*").alias("n"))
    links = tomek_links(df, key, label, vector)
    ends = links.select(F.col("key").alias("a"), F.col("other").alias("b")).unionByName(links.select(F.col("other").alias("a"), F.col("key").alias("b")))
    size = lambda k, n: df.select(F.col(key).alias(k), F.col(label).alias("l")).join(counts, "l").select(k, F.col("n").alias(n))
    gone = ends.join(size("a", "na"), "a").join(size("b", "nb"), "b").where("na >= nb").select(F.col("a").alias(key)).distinct()
    return df.join(gone, key, "left_anti")


def _drawn(df: DataFrame, label: str, wanted: DataFrame, k: int, seed: int) -> DataFrame:
    """``label, size, draw, rank, pick, at`` of every synthetic row: which row of its class, which neighbour, where between."""
    sizes = df.groupBy(label).agg(F.count("*").alias("size"))
    plan = wanted.where("n > 0").join(sizes, label).where("size > 1").select(label, "size", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("draw"))
    share = lambda tag: hash_share(F.concat(F.col(label).cast("string"), F.lit(tag), F.col("draw").cast("string")), seed)
    return plan.withColumn("rank", (F.floor(share("|b|") * F.col("size")) + 1).cast("int")).withColumn("pick", (F.floor(share("|n|") * F.least(F.lit(k), F.col("size") - 1)) + 1).cast("int")).withColumn("at", share("|t|"))


def smote(df: DataFrame, key: str, label: str, vector: str, wanted: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """``label, draw, base, neighbour, vector``: synthetic rows between a row and a near one of its class.

    ``wanted(label, n)`` states how many; base row, neighbour and position come from hashes.
    """
    rows = ranked(df, label, key, seed)
    plan = _drawn(df, label, wanted, k, seed)
    base = stored(plan.join(rows.select(label, "rank", F.col(key).alias("base"), F.col(vector).alias("v")), [label, "rank"]), "synthetic-bases")
    near = nearest(df, key, label, vector, k, within=True, asked=base.select(F.col("base").alias("key"))).select(F.col("key").alias("base"), F.col("rank").alias("pick"), F.col("other").alias("neighbour"))
    met = base.join(near, ["base", "pick"]).join(df.select(F.col(key).alias("neighbour"), F.col(vector).alias("u")), "neighbour")
    mixed = F.zip_with("v", "u", lambda a, b: a.cast("double") + (b.cast("double") - a.cast("double")) * F.col("at"))
    return met.select(label, "draw", "base", "neighbour", mixed.alias("vector"))


def smote_mixed(df: DataFrame, key: str, label: str, numbers: list[str], categories: list[str], wanted: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """``label, draw, base, neighbour, numbers, categories``: synthetic rows of tables with numbers and categories.

    As ``smote``, in a distance where each unequal category adds the square of the median of
    the class's standard deviations. Numbers lie between a row and its neighbour; a category
    is the most frequent one of the row's ``k`` neighbours, the least of equals, null being a
    value after all others. Rows with a null label or key, or a number that is null or not
    finite, take no part; a class needs two rows.
    """
    there = F.col(key).isNotNull() & F.col(label).isNotNull()
    for c in numbers:
        there = there & F.coalesce(F.abs(F.col(c).cast("double")) < float("inf"), F.lit(False))
    places = [f"c{i}" for i in range(len(categories))]
    x = F.array(*[F.col(c).cast("double") for c in numbers]).cast("array<double>")
    rows = stored(df.where(there).select(F.col(key).alias("key"), F.col(label).alias("label"), x.alias("x"), *[F.col(c).alias(p) for c, p in zip(categories, places, strict=True)]), "mixed")
    p = len(numbers)
    if p:
        spread = F.sort_array(F.array(*[F.stddev_pop(F.col("x")[i]) for i in range(p)]))
        weights = rows.groupBy("label").agg(spread.alias("s")).select("label", F.pow((F.col("s")[(p - 1) // 2] + F.col("s")[p // 2]) / 2, F.lit(2.0)).alias("weight"))
    else:
        weights = rows.select("label").distinct().withColumn("weight", F.lit(1.0))
    coded = rows.join(F.broadcast(weights), "label")  # a row per class
    for c in places:
        codes = label_codes(rows, c).select(F.col("value").alias("__value"), F.col("code").cast("double").alias(f"{c}_code"))
        coded = coded.join(codes, F.col(c) == F.col("__value"), "left").drop("__value")
    own = [F.coalesce(F.col(f"{c}_code"), F.lit(-1.0)) for c in places]
    vector = F.concat("x", F.array(*own, F.col("weight"))) if places else F.col("x")
    placed = stored(coded.select("key", "label", "x", *places, vector.alias("v")), "mixed-vectors")
    plan = _drawn(placed, "label", wanted.select(F.col(label).alias("label"), "n"), k, seed)
    base = stored(plan.join(ranked(placed, "label", "key", seed).select("label", "rank", F.col("key").alias("base"), "x"), ["label", "rank"]), "mixed-bases")
    near = stored(nearest(placed, "key", "label", "v", k, within=True, codes=len(places), asked=base.select(F.col("base").alias("key"))), "mixed-neighbours")
    met = base.join(near.select(F.col("key").alias("base"), F.col("rank").alias("place"), "other"), "base")
    met = met.join(placed.select(F.col("key").alias("other"), F.col("x").alias("u"), *places), "other")
    picked = F.col("place") == F.col("pick")
    seen = met.groupBy("label", "draw", "base", "x", "at").agg(F.max(F.when(picked, F.col("other"))).alias("neighbour"), F.max(F.when(picked, F.col("u"))).alias("u"), *[F.collect_list(F.struct(F.col(c).alias("v"))).alias(c) for c in places])  # of k neighbours

    def mode(c: str) -> Column:
        """The most frequent of a list's values, the least of equals, null last."""
        times = lambda v: F.size(F.filter(F.col(c), lambda w: w["v"].eqNullSafe(v["v"])))
        return F.array_min(F.transform(F.array_distinct(c), lambda v: F.struct((-times(v)).alias("n"), v["v"].isNull().alias("none"), v["v"].alias("v"))))["v"]

    mixed = F.zip_with("x", "u", lambda a, b: a + (b - a) * F.col("at"))
    return seen.select(F.col("label").alias(label), "draw", "base", "neighbour", mixed.alias("numbers"), F.struct(*[mode(c).alias(n) for c, n in zip(places, categories, strict=True)]).alias("categories") if places else F.lit(None).alias("categories"))


def smote_tomek(df: DataFrame, key: str, label: str, vector: str, wanted: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """``key, label, vector``: synthetic rows added (negative keys), then Tomek links cleaned."""
    made = stored(smote(df, key, label, vector, wanted, k, seed), "synthetic")
    own = F.conv(F.substring(F.md5(F.concat(F.col(label).cast("string"), F.lit("|"), F.col("draw").cast("string")).cast("binary")), 1, 15), 16, 10).cast("bigint")
    numbered = made.select((-own - 1).alias(key), label, F.col("vector").alias(vector))
    both = df.select(F.col(key).cast("bigint").alias(key), label, F.transform(vector, lambda x: x.cast("double")).alias(vector)).unionByName(numbered)
    return without_tomek(both, key, label, vector)
