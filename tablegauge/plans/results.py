"""Queries that compare, order and join result tables, and those of text columns' modes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import encode as E
from ..operators import profile as P
from ..operators import results as S
from .base import Registry, table

R = Registry()


@R.add("SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def absent_classes(spark: SparkSession, d: str) -> DataFrame:
    """Classes that a filter leaves without rows."""
    x = table(spark, d, "orders")
    return S.absent(x, x.where("o_orderpriority = '1-URGENT'"), "o_custkey")


@R.add("""WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'), b AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F'),
l AS (SELECT count(*) AS n FROM (SELECT * FROM a EXCEPT SELECT * FROM b)), r AS (SELECT count(*) AS n FROM (SELECT * FROM b EXCEPT SELECT * FROM a))
SELECT l.n AS only_left, r.n AS only_right, l.n + r.n = 0 AS equal FROM l, r""")
def class_set_equality(spark: SparkSession, d: str) -> DataFrame:
    """Whether two subsets have the same classes."""
    x = table(spark, d, "orders")
    return S.same_values(x.where("o_orderpriority = '1-URGENT'"), x.where("o_orderstatus = 'F'"), "o_custkey")


@R.add("""SELECT value, n, row_number() OVER (ORDER BY n DESC, value) AS position FROM (SELECT o_custkey AS value, count(*) AS n FROM orders GROUP BY 1)
QUALIFY position <= 10""")
def largest_classes(spark: SparkSession, d: str) -> DataFrame:
    """The ten largest classes in order."""
    return S.top(E.value_counts(table(spark, d, "orders"), "o_custkey").select("value", "n"), "n", "value", 10)


_STAGES = " UNION ALL ".join(
    f"SELECT '{stage}' AS stage, '{c}' AS \"column\", count(DISTINCT {x}) AS n_distinct, '{kind}' AS dtype FROM part WHERE {met}"
    for stage, met, price in (("full", "true", "p_retailprice"), ("filtered", "p_size <= 10", "p_retailprice"), ("rounded", "p_size <= 10", "floor(p_retailprice)"))
    for c, x, kind in (("p_brand", "p_brand", "string"), ("price", price, "double"))
)


@R.add(_STAGES)
def stage_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns of a table after each of three steps."""
    full = table(spark, d, "part").select("p_brand", F.col("p_retailprice").cast("double").alias("price"), "p_size")
    few = full.where("p_size <= 10").drop("p_size")
    return S.stage_columns({"full": full.drop("p_size"), "filtered": few, "rounded": few.withColumn("price", F.floor("price").cast("double"))})


@R.add("""WITH s AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), d AS (SELECT o_custkey, count(*) / 10.0 AS difficulty FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
f AS (SELECT o_custkey, count(*) / 100.0 AS f1 FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
SELECT o_custkey, n, coalesce(difficulty, -1.0) AS difficulty, coalesce(f1, -1.0) AS f1 FROM s LEFT JOIN d USING (o_custkey) LEFT JOIN f USING (o_custkey)""")
def result_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Statistics, difficulty and score of each group, where there are any."""
    x = table(spark, d, "orders")
    stats = x.groupBy("o_custkey").agg(F.count("*").alias("n"))
    difficulty = x.where("o_orderstatus = 'F'").groupBy("o_custkey").agg((F.count("*") / F.lit(10.0)).alias("difficulty"))
    scores = x.where("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg((F.count("*") / F.lit(100.0)).alias("f1"))
    return S.looked_up(stats, "o_custkey", difficulty, scores, default=-1.0)


_WIDTH = """SELECT '{c}' AS "column", CASE WHEN min({x}) >= 0 THEN CASE WHEN max({x}) < 256 THEN 'uint8' WHEN max({x}) < 65536 THEN 'uint16' WHEN max({x}) < 4294967296 THEN 'uint32' ELSE 'uint64' END
WHEN min({x}) >= -128 AND max({x}) < 128 THEN 'int8' WHEN min({x}) >= -32768 AND max({x}) < 32768 THEN 'int16' WHEN min({x}) >= -2147483648 AND max({x}) < 2147483648 THEN 'int32' ELSE 'int64' END AS width FROM part"""


@R.add(" UNION ALL ".join(_WIDTH.format(c=c, x=x) for c, x in (("p_partkey", "p_partkey"), ("p_size", "p_size"), ("moved", "p_size - 200"), ("large", "p_partkey * 100000000"))))
def fit_unsigned_width(spark: SparkSession, d: str) -> DataFrame:
    """The narrowest signed or unsigned width of each whole-number column."""
    x = table(spark, d, "part").select("p_partkey", "p_size", (F.col("p_size") - 200).alias("moved"), (F.col("p_partkey").cast("bigint") * 100000000).alias("large"))
    return P.fit_width(x, unsigned=True)


_CODE = """CASE WHEN (SELECT count(DISTINCT {c}) FROM customer) <= 1000 THEN dense_rank() OVER (ORDER BY {c}) - 1
ELSE CAST('0x' || substr(md5({c} || '#42'), 1, 8) AS BIGINT) % 1024 END AS {c}"""


@R.add(f"SELECT c_custkey, {_CODE.format(c='c_name')}, {_CODE.format(c='c_mktsegment')} FROM customer")
def text_columns_encoded(spark: SparkSession, d: str) -> DataFrame:
    """Text columns as codes where they have few values, else as hash buckets."""
    x = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return E.text_columns(x, "encode", portable=True)


@R.add("SELECT c_custkey FROM customer")
def text_columns_dropped(spark: SparkSession, d: str) -> DataFrame:
    """A table without its text columns."""
    return E.text_columns(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), "drop")
