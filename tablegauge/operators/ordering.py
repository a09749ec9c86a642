"""Ranks, running sums and exact quantiles that give no task a whole class or table.

Rows are cut into parts by their place in the order; parts are counted, the few counts
are summed up, and only rows of one part are ordered against each other.

Most of these read their input two or three times: give them a table that is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stored import stored

#: Leading digits (16 values each) of a hash that make a part.
HASH_DIGITS = 3
#: Parts of a range of values.
PARTS = 256
#: Rank error of a sketch is one over this share of the rows.
ACCURACY = 10_000


def _joined(rows: DataFrame, few: DataFrame, on: list[str], sent: bool = False) -> DataFrame:
    """An inner join on columns that may be null, without those of ``few``, which where ``sent`` goes to all tasks."""
    other = few.toDF(*[f"__few_{c}" if c in on else c for c in few.columns])
    met = F.lit(True)
    for c in on:
        met = met & F.col(c).eqNullSafe(F.col(f"__few_{c}"))
    return rows.join(F.broadcast(other) if sent else other, met).drop(*[f"__few_{c}" for c in on])


def hash_ranked(df: DataFrame, hashed: Column, key: str, *by: str, out: str = "rank", size: str | None = None) -> DataFrame:
    """Rows numbered from 1 in the order of a hexadecimal hash, then ``key``, within ``by``.

    ``size`` names a column for the rows of each group.
    """
    rows = df.withColumn("__hash", hashed).withColumn("__part", F.coalesce(F.substring("__hash", 1, HASH_DIGITS), F.lit("")))
    counts = rows.groupBy(*by, "__part").agg(F.count("*").alias("__n"))
    group = Window.partitionBy(*by)  # of at most 16 ** HASH_DIGITS parts
    before = F.coalesce(F.sum("__n").over(group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = counts.select(*by, "__part", before.alias("__before"), F.sum("__n").over(group).alias("__size"))
    own = F.row_number().over(Window.partitionBy(*by, "__part").orderBy("__hash", F.col(key)))
    done = _joined(rows.withColumn("__own", own), places, [*by, "__part"])
    extra = [F.col("__size").alias(size)] if size else []
    return done.select(*[F.col(c) for c in df.columns if c not in (out, size)], (F.col("__before") + F.col("__own")).alias(out), *extra)


def ranked_in_order(df: DataFrame, by: list[str], order: list[Column], out: str = "rank") -> DataFrame:
    """Rows numbered from 1 in any order within ``by``.

    Rows of all groups are dealt out by sampled splitters of group and order, sorted in their
    tasks, and numbered there after the counted rows before them: a group of any size, and
    ties in the order's first columns, are spread over many tasks. The result is written.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.repartitionByRange(parts, *by, *order).sortWithinPartitions(*by, *order)
    # the id holds the partition above its 33 lower bits, and there the place in it
    placed = stored(dealt.withColumn("__at", F.monotonically_increasing_id()), "ranked").withColumn("__part", F.shiftright("__at", 33))
    counts = placed.groupBy(*by, "__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per partition
    places = counts.select(*by, "__part", (before - F.col("__first") + 1).alias("__from"))
    return _joined(placed, places, [*by, "__part"]).select(*[c for c in df.columns if c != out], (F.col("__at") + F.col("__from")).alias(out))


def running_before(values: DataFrame, order: str, amount: str, *by: str, out: str = "before") -> DataFrame:
    """``out``: the sum of ``amount`` over the smaller values of ``order`` in the group; values are distinct in it."""
    cuts = [k / PARTS for k in range(1, PARTS)]
    edges = values.groupBy(*by).agg(F.percentile_approx(F.col(order).cast("double"), cuts, F.lit(ACCURACY)).alias("__edges"))
    rows = _joined(values, edges, list(by)) if by else values.crossJoin(F.broadcast(edges))  # a single row
    rows = rows.withColumn("__part", F.size(F.filter(F.array_distinct("__edges"), lambda e: e < F.col(order)))).drop("__edges")
    group = Window.partitionBy(*by).orderBy("__part")  # of at most PARTS parts
    totals = rows.groupBy(*by, "__part").agg(F.sum(amount).alias("__n"))
    places = totals.select(*by, "__part", F.coalesce(F.sum("__n").over(group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    own = F.coalesce(F.sum(amount).over(Window.partitionBy(*by, "__part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return _joined(rows.withColumn("__own", own), places, [*by, "__part"]).select(*values.columns, (F.col("__before") + F.col("__own")).alias(out))


def quantiles(df: DataFrame, columns: list[str], shares: list[float], *by: str) -> DataFrame:
    """``by, feature, q``: the exact quantiles of each column, as an array, interpolated between neighbours; nulls are left out.

    A sketch brackets every quantile within a few ten-thousandths of the rows; rows below
    each bracket are counted, and only the distinct values inside are put in order. A group
    without values has no row. Without ``by`` the sketch, a row for each column, is sent to
    all rows; a join by the few columns would give a task all rows of one.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])
    long = df.select(*by, F.explode(cells).alias("c")).select(*by, "c.*").where("x is not null")
    keys, m = [*by, "feature"], len(shares)
    wide = 2 / ACCURACY
    marks = [max(0.0, p - wide) for p in shares] + [min(1.0, p + wide) for p in shares]
    sketch = long.groupBy(*keys).agg(F.count("*").alias("__n"), F.percentile_approx("x", marks, F.lit(ACCURACY)).alias("__e"), F.min("x").alias("__lo"), F.max("x").alias("__hi"))
    few = F.col("__n") < 5 * ACCURACY  # where the brackets hold less than ten ranks, all values are put in order
    low = F.array(*[F.when(few | F.lit(p <= wide), F.col("__lo")).otherwise(F.col("__e")[i]) for i, p in enumerate(shares)])
    high = F.array(*[F.when(few | F.lit(p >= 1 - wide), F.col("__hi")).otherwise(F.col("__e")[m + i]) for i, p in enumerate(shares)])
    sketch = sketch.select(*keys, "__n", low.alias("__low"), high.alias("__high"))
    rows = _joined(long, sketch, keys, not by)
    below = rows.groupBy(*keys, "__n").agg(F.array(*[F.sum(F.when(F.col("x") < F.col("__low")[i], 1).otherwise(0)) for i in range(m)]).alias("__below"))
    inside = F.filter(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: (F.col("x") >= F.col("__low")[i]) & (F.col("x") <= F.col("__high")[i]))
    near = rows.select(*keys, "x", F.explode(inside).alias("__i")).groupBy(*keys, "__i", "x").agg(F.count("*").alias("__c"))
    upto = F.sum("__c").over(Window.partitionBy(*keys, "__i").orderBy("x"))
    placed = _joined(near.withColumn("__upto", upto), below, keys, not by)
    at = F.element_at(F.array(*[F.lit(float(p)) for p in shares]), F.col("__i") + 1) * (F.col("__n") - 1)
    end = F.col("__below")[F.col("__i")] + F.col("__upto")
    first = lambda rank: F.min(F.when(end > rank, F.col("x")))  # noqa: E731 - the value of a rank from 0
    found = placed.groupBy(*keys, "__i").agg(first(F.floor(at)).alias("__a"), first(F.ceil(at)).alias("__b"), F.first(at).alias("__at"))
    value = F.when(F.col("__a") == F.col("__b"), F.col("__a")).otherwise((F.ceil("__at") - F.col("__at")) * F.col("__a") + (F.col("__at") - F.floor("__at")) * F.col("__b"))
    return found.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("__i", value.alias("v")))), lambda x: x["v"]).alias("q"))
