"""Encoding, binning and scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stored import stored
from .ordering import quantiles
from .profile import column_profile


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """``value, n, share`` of a column."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("__total"))
    return counts.join(F.broadcast(total), F.lit(True)).select("value", "n", (F.col("n") / F.col("__total")).alias("share"))  # a single row


def frequency_encode(df: DataFrame, column: str, out: str, share: bool = True, fitted: DataFrame | None = None) -> DataFrame:
    """A column's values as their share (or count) in ``fitted``, itself by default; unseen values null.

    The original column stays beside the encoding.
    """
    counts = value_counts(fitted if fitted is not None else df, column).select(F.col("value").alias("__v"), F.col("share" if share else "n").alias(out))
    return df.join(counts, F.col(column).eqNullSafe(F.col("__v")), "left").drop("__v")


def hash_buckets(n_distinct: int, most: int = 1 << 16) -> int:
    """Buckets for a cardinality: the power of two over 1.1 times it, bounded."""
    size = 1
    while size < 1.1 * n_distinct:
        size *= 2
    return min(size, most)


def hash_encode(x: Column, buckets: int, seed: int = 42, portable: bool = False) -> Column:
    """A value's bucket; ``portable`` uses md5, which other engines share."""
    if portable:
        return F.conv(F.substring(F.md5(F.concat(x.cast("string"), F.lit(f"#{seed}"))), 1, 8), 16, 10).cast("bigint") % buckets
    return F.pmod(F.xxhash64(x) + seed, F.lit(buckets))


def cardinality_plan(df: DataFrame, low: int = 1 << 14, high: int = 1 << 18) -> DataFrame:
    """What each text column should become: category, frequency, count or hash.

    Between the bounds the skewness of its value counts decides.
    """
    text = [c for c, t in df.dtypes if t == "string"]
    p = column_profile(df.select(*text)).select("column", "n_distinct")
    skew = None
    for c in text:
        s = df.groupBy(c).agg(F.count("*").alias("n")).agg(F.skewness("n").alias("skew")).select(F.lit(c).alias("column"), "skew")
        skew = s if skew is None else skew.unionByName(s)
    action = F.when(F.col("n_distinct") < low, "category").when(F.col("n_distinct") > high, "hash").when(F.abs("skew") > 1, "frequency").otherwise("count")
    return p.join(skew, "column").select("column", "n_distinct", action.alias("action"))


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """``value, code``: codes from 0 in alphabetical order; nulls have none.

    Distinct values are dealt out by splitters sampled from them, so those that begin alike
    are many tasks' too; each numbers its own, after the counted values of those before.
    """
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    spark = df.sparkSession
    dealt = values.repartitionByRange(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "value").sortWithinPartitions("value")
    # the id holds the partition above its 33 lower bits, and there the place in it
    placed = stored(dealt.select("value", F.monotonically_increasing_id().alias("at")), "codes").withColumn("part", F.shiftright("at", 33))
    counts = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per partition
    places = counts.select("part", before.alias("before"))
    return placed.join(F.broadcast(places), "part").select("value", (F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).cast("int").alias("code"))


def encode_labels(df: DataFrame, column: str, codes: DataFrame, unseen: int = -1) -> DataFrame:
    """The column's codes beside it; values without one get ``unseen``."""
    return df.join(codes.select(F.col("value").alias(column), "code"), column, "left").withColumn("code", F.coalesce("code", F.lit(unseen)))


def text_columns(df: DataFrame, mode: str = "encode", most: int = 1000, buckets: int = 1024, portable: bool = False, but: tuple[str, ...] = ()) -> DataFrame:
    """Text columns, those of ``but`` aside, kept, dropped, or encoded in place.

    A column of up to ``most`` values becomes its alphabetical code, any other a hash bucket.
    """
    if mode not in ("keep", "drop", "encode"):
        raise ValueError(f"no mode {mode!r} for text columns")
    names = [c for c, t in df.dtypes if t == "string" and c not in but]
    if mode == "keep" or not names:
        return df
    if mode == "drop":
        return df.drop(*names)
    distinct = {r["column"]: r["n_distinct"] for r in column_profile(df.select(*names)).collect()}  # a row per column
    for c in names:
        if distinct[c] > most:
            df = df.withColumn(c, hash_encode(F.col(c), buckets, portable=portable).cast("bigint"))
            continue
        codes = label_codes(df, c).select(F.col("value").alias("__value"), F.col("code").cast("bigint").alias("__code"))
        df = df.join(F.broadcast(codes), F.col(c) == F.col("__value"), "left").withColumn(c, F.col("__code")).drop("__value", "__code")  # ``most`` rows
    return df


def one_hot(df: DataFrame, column: str, drop_first: bool = False) -> DataFrame:
    """A 0/1 column for each value, in alphabetical order; for columns of few values."""
    values = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).limit(1001).collect()]
    if len(values) > 1000:
        raise ValueError(f"{column} has more than 1000 values")
    flags = [F.coalesce((F.col(column) == v), F.lit(False)).cast("int").alias(f"{column}_{v}") for v in values[int(drop_first) :]]
    return df.select("*", *flags)


def smart_encode(df: DataFrame, columns: list[str], few: int = 3) -> DataFrame:
    """One-hot up to ``few`` values, sorted codes beyond."""
    for c in columns:
        codes = label_codes(df, c)
        if codes.count() <= few:
            df = one_hot(df, c)
        else:
            df = encode_labels(df, c, codes).withColumnRenamed("code", f"{c}_code")
    return df


def quantile_edges(df: DataFrame, column: str, bins: int) -> list[float]:
    """Distinct edges of equal-frequency bins."""
    got = quantiles(df, [column], [i / bins for i in range(bins + 1)]).first()
    return sorted(set(got["q"])) if got else []


def bin_label(x: Column, edges: list[float], prefix: str = "Q") -> Column:
    """Right-closed bins between edges, numbered from 1; the lowest edge belongs to the first."""
    out = F.when(x.isNull() | (x < edges[0]), None)
    for k, edge in enumerate(edges[1:], 1):
        out = out.when(x <= edge, f"{prefix}{k}")
    return out


def quantile_bins(df: DataFrame, column: str, out: str, bins: int = 100) -> DataFrame:
    """Equal-frequency bins with repeated edges dropped."""
    edges = quantile_edges(df, column, bins)
    return df.withColumn(out, bin_label(F.col(column), edges) if len(edges) > 1 else F.lit("Q1"))


def width_bins(df: DataFrame, column: str, out: str, bins: int = 100) -> DataFrame:
    """Equal-width bins, numbered from 0; the largest value is in the last."""
    span = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    x = F.col(column).cast("double")
    at = F.least(F.floor((x - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    return df.crossJoin(F.broadcast(span)).withColumn(out, F.when(F.col("hi") > F.col("lo"), at).otherwise(F.lit(0)).cast("int")).drop("lo", "hi")


def scaled(df: DataFrame, columns: list[str], method: str, fitted: DataFrame | None = None) -> DataFrame:
    """Columns scaled by statistics of ``fitted``: standard, minmax, maxabs, robust; or row ``norm``.

    A constant column scales to 0 (maxabs: a zero column).
    """
    x = {c: F.col(c).cast("double") for c in columns}
    if method == "norm":
        size = F.sqrt(sum((v * v for v in x.values()), F.lit(0.0)))
        return df.withColumns({c: F.when(size > 0, v / size).otherwise(0.0) for c, v in x.items()})
    stats = {
        "standard": lambda c: (F.avg(c), F.stddev_pop(c)),
        "minmax": lambda c: (F.min(c), F.max(c) - F.min(c)),
        "maxabs": lambda c: (F.lit(0.0), F.max(F.abs(c))),
    }
    source = fitted if fitted is not None else df
    if method == "robust":
        cuts = quantiles(source, columns, [0.25, 0.5, 0.75])
        own = lambda c, i: F.max(F.when(F.col("feature") == c, F.col("q")[i]))
        one = cuts.agg(*[e for c in columns for e in (own(c, 1).alias(f"__s_{c}"), (own(c, 2) - own(c, 0)).alias(f"__w_{c}"))])
    else:
        one = source.agg(*[e.alias(f"__{k}_{c}") for c, v in x.items() for k, e in zip("sw", stats[method](v), strict=True)])
    done = df.crossJoin(F.broadcast(one))  # a single row
    for c, v in x.items():
        done = done.withColumn(c, F.when(F.col(f"__w_{c}") > 0, (v - F.col(f"__s_{c}")) / F.col(f"__w_{c}")).otherwise(0.0))
    return done.select(*df.columns)


def inverse_frequency_weights(df: DataFrame, label: str) -> DataFrame:
    """Each row weighted by one over its class's count."""
    counts = df.groupBy(label).agg((F.lit(1.0) / F.count("*")).alias("weight"))
    return df.join(counts, label, "left")


def metric_matrix(df: DataFrame, label: str, few: int = 200) -> DataFrame:
    """Numeric features ready for metrics: few-valued ones by frequency, others standardised."""
    numeric = [c for c in df.columns if c != label]
    counts = {r["column"]: r["n_distinct"] for r in column_profile(df.select(*numeric)).collect()}  # a row per column
    rest = [c for c in numeric if counts[c] >= few]
    for c in numeric:
        if counts[c] < few:
            df = frequency_encode(df, c, "__f").drop(c).withColumnRenamed("__f", c)
    return scaled(df, rest, "standard").select(*numeric, label) if rest else df.select(*numeric, label)
