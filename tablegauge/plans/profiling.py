"""Queries of profiles, aggregates, encoders and samplers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import encode as E
from ..operators import moments as M
from ..operators import profile as P
from ..operators import sample as A
from ..operators.ordering import quantiles
from .base import Registry, table

R = Registry()


def _union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


_ORDERS = {"o_orderkey": ("bigint", 8), "o_custkey": ("bigint", 8), "o_orderstatus": ("string", None), "o_totalprice": ("double", 8), "o_orderpriority": ("string", None)}


@R.add(_union([f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count(*) AS n, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_distinct, CAST({f'{w} * count(*)' if w else f'sum(strlen({c}))'} AS BIGINT) AS bytes FROM orders" for c, (t, w) in _ORDERS.items()]))
def column_profile(spark: SparkSession, d: str) -> DataFrame:
    """Rows, nulls, distinct values, type and bytes of every column."""
    return P.column_profile(table(spark, d, "orders").select(*_ORDERS))


_KIND = "CASE WHEN count(x) = 0 THEN 'unknown' WHEN count(CASE WHEN regexp_matches(trim(x), '^[+-]?[0-9]{1,18}$') THEN 1 END) = count(x) THEN 'integer' WHEN count(TRY_CAST(trim(x) AS DOUBLE)) = count(x) THEN 'float' ELSE 'categorical' END"


@R.add(_union([f"SELECT '{c}' AS \"column\", {_KIND} AS kind, count(DISTINCT x) AS n_distinct FROM (SELECT CAST({c} AS VARCHAR) AS x FROM orders)" for c in ("o_orderkey", "o_orderstatus", "o_custkey", "o_totalprice")]))
def infer_types(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of columns by their values."""
    return P.infer_types(table(spark, d, "orders").select(*[F.col(c).cast("string").alias(c) for c in ("o_orderkey", "o_orderstatus", "o_custkey", "o_totalprice")]))


@R.add("SELECT 'k' AS \"column\", count(x) AS n, count(CASE WHEN regexp_matches(trim(x), '^[+-]?[0-9]{1,18}$') THEN 1 END) AS n_integer, count(TRY_CAST(x AS DOUBLE)) AS n_number, count(DISTINCT x) AS n_distinct FROM (SELECT json_extract_string(props, '$.k') AS x FROM events)")
def numeric_castability(spark: SparkSession, d: str) -> DataFrame:
    """How much of a text column reads as numbers."""
    return P.castability(table(spark, d, "events").select(F.get_json_object("props", "$.k").alias("k")))


@R.add("SELECT 'c_custkey' AS \"column\", count(*) AS n, count(DISTINCT c_custkey) AS n_distinct FROM customer UNION ALL SELECT 'c_name', count(*), count(DISTINCT c_name) FROM customer")
def identifier_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns in which every row differs."""
    return P.identifier_columns(table(spark, d, "customer"), "c_mktsegment")


@R.add("SELECT 'almost' AS \"column\", count(*) AS n, count(DISTINCT x) AS n_distinct FROM (SELECT CASE WHEN c_custkey <= 2 THEN 1 ELSE c_custkey END AS x FROM customer)")
def near_unique_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns of nearly as many values as rows."""
    k = F.col("c_custkey")
    return P.near_unique(table(spark, d, "customer").select("c_custkey", F.when(k <= 2, 1).otherwise(k).alias("almost"), "c_mktsegment"), 0.99)


@R.add("SELECT 'ip' AS \"column\", avg(CASE WHEN event_id % 20 = 0 THEN 0 ELSE 1 END) AS share FROM events UNION ALL SELECT 'event_type', 0.0")
def ip_share(spark: SparkSession, d: str) -> DataFrame:
    """Share of address texts in each column."""
    i = F.col("event_id")
    ip = F.when(i % 20 == 0, "none").when(i % 3 == 0, F.concat(F.lit("fe80::"), F.hex(i % 4096))).otherwise(F.concat_ws(".", F.lit("10"), *[(i % m).cast("string") for m in (256, 100, 7)]))
    return P.pattern_shares(table(spark, d, "events").select(ip.alias("ip"), "event_type"), P.is_ip)


@R.add("SELECT 'mac' AS \"column\", avg(CASE WHEN event_id % 25 = 0 THEN 0 ELSE 1 END) AS share FROM events UNION ALL SELECT 'event_type', 0.0")
def mac_share(spark: SparkSession, d: str) -> DataFrame:
    """Share of hardware-address texts in each column."""
    i = F.col("event_id")
    mac = F.when(i % 25 == 0, "00:11").when(i % 2 == 0, F.substring(F.md5(i.cast("string")), 1, 12)).otherwise(F.concat(F.lit("00-1a-2b-3c-4d-"), F.lpad(F.hex(i % 256), 2, "0")))
    return P.pattern_shares(table(spark, d, "events").select(mac.alias("mac"), "event_type"), P.is_mac)


@R.add("SELECT 'src_port' AS \"column\", avg(CASE WHEN (event_id * 37) % 66000 BETWEEN 0 AND 65535 THEN 1 ELSE 0 END) AS share FROM events")
def port_like_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns that look like ports."""
    return P.port_like(table(spark, d, "events").select(((F.col("event_id") * 37) % 66000).alias("src_port"), (F.col("user_id") * 100000).alias("dst_port"), F.col("user_id").alias("port_time")))


@R.add("SELECT bin, count(*) AS n FROM (SELECT CASE WHEN p IN (80, 8080) THEN CASE p WHEN 80 THEN 'HTTP' ELSE 'MQTT-WS' END WHEN p = 443 THEN 'HTTPS' WHEN p > 65535 THEN 'Other' ELSE 'Registered_1024_49151' END AS bin FROM (SELECT CASE event_id % 5 WHEN 0 THEN 80 WHEN 1 THEN 443 WHEN 2 THEN 8080 WHEN 3 THEN 70000 ELSE 30000 END AS p FROM events)) GROUP BY bin")
def port_binning(spark: SparkSession, d: str) -> DataFrame:
    """Detected port columns binned by service."""
    p = F.element_at(F.array(*[F.lit(x) for x in (80, 443, 8080, 70000, 30000)]), (F.col("event_id") % 5 + 1).cast("int"))
    x = table(spark, d, "events").select(p.alias("sport"))
    found = [r["column"] for r in P.port_like(x, 0.5).collect()]  # a row per column
    return x.select(*[S.port_service(F.col(c)).alias("bin") for c in found]).groupBy("bin").agg(F.count("*").alias("n"))


_FIT = "CASE WHEN min({c}) >= -128 AND max({c}) < 128 THEN 'tinyint' WHEN min({c}) >= -32768 AND max({c}) < 32768 THEN 'smallint' WHEN min({c}) >= -2147483648 AND max({c}) < 2147483648 THEN 'int' ELSE 'bigint' END"


@R.add(_union([f"SELECT '{c}' AS \"column\", {_FIT.format(c=c)} AS width FROM lineitem" for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")]))
def fit_numeric_width(spark: SparkSession, d: str) -> DataFrame:
    """The narrowest type of each whole-number column."""
    return P.fit_width(table(spark, d, "lineitem"))


@R.add(_union([f"SELECT '{c}' AS \"column\", round(var_pop({c}), 9) AS variance FROM lineitem HAVING var_pop({c}) < 0.1" for c in ("l_discount", "l_tax", "l_quantity")]))
def low_variance_columns(spark: SparkSession, d: str) -> DataFrame:
    """Numeric columns of little variance."""
    x = table(spark, d, "lineitem").select("l_discount", "l_tax", "l_quantity", "l_returnflag")
    return P.low_variance(x, "l_returnflag").select("column", F.round("variance", 9).alias("variance"))


@R.add("""SELECT 'nation' AS name, 'bigint,int,string' AS kinds, 3 AS n_columns, count(*) AS n_rows, CAST(8 * count(*) + 4 * count(*) + sum(strlen(n_name)) AS BIGINT) AS bytes FROM (SELECT CAST(n_nationkey AS BIGINT) AS k, n_name FROM nation)
UNION ALL SELECT 'supplier', 'bigint,double,int,string', 4, count(*), CAST(20 * count(*) + sum(strlen(s_name)) AS BIGINT) FROM supplier""")
def table_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Kinds, rows and bytes of tables, smallest first."""
    return P.catalogue({"nation": table(spark, d, "nation").withColumn("n_nationkey", F.col("n_nationkey").cast("bigint")), "supplier": table(spark, d, "supplier")})


@R.add("SELECT event_type AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY event_type")
def value_counts_share(spark: SparkSession, d: str) -> DataFrame:
    """Absolute and relative value counts."""
    return E.value_counts(table(spark, d, "events"), "event_type").select("value", "n", F.round("share", 6).alias("share"))


_NUM = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@R.add(_union([f"SELECT '{c}' AS feature, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS least, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.75) AS q3, max({c}) AS most FROM lineitem" for c in _NUM]))
def describe_numeric(spark: SparkSession, d: str) -> DataFrame:
    """Count, mean, deviation, quartiles and range of each feature."""
    return M.describe(table(spark, d, "lineitem"), list(_NUM))


@R.add("SELECT count(x) AS size, max(x) AS max, min(x) AS min, round(avg(x), 6) AS mean, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3, round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 6) AS iqr, round(stddev_pop(x), 6) AS std, round(var_pop(x), 6) AS variance FROM (SELECT value AS x FROM events)")
def ten_number_summary(spark: SparkSession, d: str) -> DataFrame:
    """Ten statistics of a set of values."""
    s = M.summary(table(spark, d, "events").select(F.col("value").alias("x")), "x")
    return s.select("size", "max", "min", F.round("mean", 6).alias("mean"), "median", "q1", "q3", *[F.round(c, 6).alias(c) for c in ("iqr", "std", "variance")])


@R.add("WITH c AS (SELECT count(*) AS n FROM documents GROUP BY text), m AS (SELECT avg(n) AS mu FROM c) SELECT count(*) AS n_values, round(avg(power(n - mu, 3)) / power(avg(power(n - mu, 2)), 1.5), 6) AS skewness FROM c, m")
def count_skewness(spark: SparkSession, d: str) -> DataFrame:
    """Skewness of the counts of a column's values."""
    c = table(spark, d, "documents").groupBy("text").agg(F.count("*").alias("n"))
    return c.agg(F.count("*").alias("n_values"), F.round(F.skewness("n"), 6).alias("skewness"))


@R.add(_union([f"SELECT l_returnflag AS label, '{c}' AS feature, count({c}) AS n, round(avg({c}), 6) AS mean, round(var_pop({c}) * count({c}) / 1e4, 2) AS m2 FROM lineitem GROUP BY l_returnflag" for c in _NUM]))
def class_moments(spark: SparkSession, d: str) -> DataFrame:
    """Count, mean and centred squares per class and feature."""
    m = M.class_moments(table(spark, d, "lineitem"), "l_returnflag", list(_NUM))
    return m.select("label", "feature", "n", F.round("mean", 6).alias("mean"), F.round(F.col("m2") / 1e4, 2).alias("m2"))


@R.add("SELECT l_returnflag AS label, quantile_cont(l_extendedprice, 0.1) AS q FROM lineitem GROUP BY 1")
def class_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """A quantile per class."""
    return quantiles(table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "label"), ["l_extendedprice"], [0.1], "label").select("label", F.col("q")[0].alias("q"))


@R.add(_union([f"SELECT l_returnflag AS label, '{a}' AS a, '{b}' AS b, round(covar_samp({a}, {b}), 4) AS covariance FROM lineitem GROUP BY 1" for i, a in enumerate(_NUM) for b in _NUM[i:]]))
def class_covariance(spark: SparkSession, d: str) -> DataFrame:
    """Sample covariance of feature pairs per class."""
    c = M.class_covariance(table(spark, d, "lineitem"), "l_returnflag", list(_NUM))
    return c.select("label", "a", "b", F.round("covariance", 4).alias("covariance"))


@R.add("""WITH r AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
SELECT 'l_extendedprice' AS feature, CAST(least(floor((l_extendedprice - lo) / (hi - lo) * 20), 19) AS INTEGER) AS bin, l_returnflag AS label, count(*) AS n FROM lineitem, r GROUP BY ALL""")
def feature_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Equal-width histogram of a feature by class."""
    return M.histogram(table(spark, d, "lineitem"), "l_returnflag", ["l_extendedprice"], 20)


@R.add("SELECT o_orderpriority, max(o_totalprice) AS best_price, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS best_key FROM orders GROUP BY 1")
def best_row_per_group(spark: SparkSession, d: str) -> DataFrame:
    """The best row of each group."""
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.max("o_totalprice").alias("best_price"), F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("best_key"))


@R.add("SELECT o_orderpriority, round(n / (SELECT count(*) FROM orders), 6) AS share, count(*) AS n_rows FROM orders JOIN (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1) USING (o_orderpriority) GROUP BY ALL")
def frequency_encode(spark: SparkSession, d: str) -> DataFrame:
    """Values as their share."""
    e = E.frequency_encode(table(spark, d, "orders"), "o_orderpriority", "share")
    return e.groupBy("o_orderpriority", F.round("share", 6).alias("share")).agg(F.count("*").alias("n_rows"))


@R.add("SELECT event_id, n AS encoded FROM events JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) USING (user_id)")
def count_encode(spark: SparkSession, d: str) -> DataFrame:
    """Values as their count."""
    return E.frequency_encode(table(spark, d, "events").select("event_id", "user_id"), "user_id", "encoded", share=False).select("event_id", "encoded")


@R.add("SELECT c_custkey, CAST(concat('0x', substr(md5(concat(c_name, '#42')), 1, 8)) AS BIGINT) % 2048 AS bucket FROM customer")
def hash_encode(spark: SparkSession, d: str) -> DataFrame:
    """Texts as hash buckets."""
    return table(spark, d, "customer").select("c_custkey", E.hash_encode(F.col("c_name"), 2048, portable=True).alias("bucket"))


@R.add("""SELECT 'p_name' AS "column", count(DISTINCT p_name) AS n_distinct, CASE WHEN count(DISTINCT p_name) < 10 THEN 'category' WHEN count(DISTINCT p_name) > 1000 THEN 'hash' ELSE 'count' END AS action FROM part
UNION ALL SELECT 'p_type', count(DISTINCT p_type), 'category' FROM part""")
def cardinality_plan(spark: SparkSession, d: str) -> DataFrame:
    """What each text column should become."""
    return E.cardinality_plan(table(spark, d, "part").select("p_name", "p_type"), 10, 1000)


@R.add("WITH c AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS code FROM (SELECT DISTINCT p_type FROM part)) SELECT p_partkey, coalesce(CASE WHEN p_partkey % 10 <> 0 THEN code END, -1) AS code FROM part JOIN c USING (p_type)")
def label_codes(spark: SparkSession, d: str) -> DataFrame:
    """Alphabetical codes, -1 for an unseen value."""
    p = table(spark, d, "part").select("p_partkey", "p_type")
    changed = p.withColumn("p_type", F.when(F.col("p_partkey") % 10 == 0, "UNSEEN").otherwise(F.col("p_type")))
    return E.encode_labels(changed, "p_type", E.label_codes(p, "p_type")).select("p_partkey", "code")


@R.add('SELECT o_orderkey, CAST(o_orderstatus = \'F\' AS INTEGER) AS "o_orderstatus_F", CAST(o_orderstatus = \'O\' AS INTEGER) AS "o_orderstatus_O", CAST(o_orderstatus = \'P\' AS INTEGER) AS "o_orderstatus_P" FROM orders')
def one_hot(spark: SparkSession, d: str) -> DataFrame:
    """A flag for each value."""
    return E.one_hot(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus").drop("o_orderstatus")


@R.add("""WITH c AS (SELECT o_orderpriority, row_number() OVER (ORDER BY o_orderpriority) - 1 AS code FROM (SELECT DISTINCT o_orderpriority FROM orders))
SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS "o_orderstatus_F", CAST(o_orderstatus = 'O' AS INTEGER) AS "o_orderstatus_O", CAST(o_orderstatus = 'P' AS INTEGER) AS "o_orderstatus_P", code AS "o_orderpriority_code" FROM orders JOIN c USING (o_orderpriority)""")
def smart_encode(spark: SparkSession, d: str) -> DataFrame:
    """One-hot for few values, codes for more."""
    x = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return E.smart_encode(x, ["o_orderstatus", "o_orderpriority"]).drop("o_orderstatus", "o_orderpriority")


@R.add("""WITH q AS (SELECT quantile_cont(value, [0.0, 0.25, 0.5, 0.75, 1.0]) AS e FROM events)
SELECT CASE WHEN value <= e[2] THEN 'Q1' WHEN value <= e[3] THEN 'Q2' WHEN value <= e[4] THEN 'Q3' ELSE 'Q4' END AS bin, count(*) AS n FROM events, q GROUP BY 1""")
def quantile_bins(spark: SparkSession, d: str) -> DataFrame:
    """Equal-frequency bins."""
    return E.quantile_bins(table(spark, d, "events"), "value", "bin", 4).groupBy("bin").agg(F.count("*").alias("n"))


@R.add("WITH r AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part) SELECT CAST(least(floor((p_retailprice - lo) / (hi - lo) * 100), 99) AS INTEGER) AS bin, count(*) AS n FROM part, r GROUP BY 1")
def equal_width_bins(spark: SparkSession, d: str) -> DataFrame:
    """Equal-width bins."""
    return E.width_bins(table(spark, d, "part"), "p_retailprice", "bin", 100).groupBy("bin").agg(F.count("*").alias("n"))


def _scaler(name: str, method: str, expression: str, doc: str) -> None:
    sql = f"WITH s AS (SELECT avg(p_retailprice) AS mu, stddev_pop(p_retailprice) AS sd, min(p_retailprice) AS lo, max(p_retailprice) AS hi, max(abs(p_retailprice)) AS top, quantile_cont(p_retailprice, 0.5) AS med, quantile_cont(p_retailprice, 0.75) - quantile_cont(p_retailprice, 0.25) AS iqr FROM part) SELECT p_partkey, round({expression}, 6) AS scaled FROM part, s"

    def query(spark: SparkSession, d: str) -> DataFrame:
        return E.scaled(table(spark, d, "part"), ["p_retailprice", "p_size"], method).select("p_partkey", F.round("p_retailprice", 6).alias("scaled"))

    query.__name__, query.__doc__ = name, doc
    R.add(sql)(query)


_scaler("scale_standard", "standard", "(p_retailprice - mu) / sd", "Zero mean and unit deviation.")
_scaler("scale_minmax", "minmax", "(p_retailprice - lo) / (hi - lo)", "The unit interval.")
_scaler("scale_maxabs", "maxabs", "p_retailprice / top", "The largest magnitude is one.")
_scaler("scale_robust", "robust", "(p_retailprice - med) / iqr", "Zero median and unit quartile range.")
_scaler("scale_row_norm", "norm", "p_retailprice / sqrt(p_retailprice * p_retailprice + p_size * p_size)", "Rows of unit length.")


@R.add("SELECT o_orderpriority, round(sum(1.0 / n), 6) AS total_weight FROM orders JOIN (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1) USING (o_orderpriority) GROUP BY 1")
def inverse_frequency_weights(spark: SparkSession, d: str) -> DataFrame:
    """Row weights of one over the class count."""
    return E.inverse_frequency_weights(table(spark, d, "orders"), "o_orderpriority").groupBy("o_orderpriority").agg(F.round(F.sum("weight"), 6).alias("total_weight"))


@R.add("""WITH s AS (SELECT avg(p_retailprice) AS mu, stddev_pop(p_retailprice) AS sd, count(*) AS n FROM part), f AS (SELECT p_size, count(*) AS k FROM part GROUP BY 1)
SELECT round(k / n, 6) AS p_size, round((p_retailprice - mu) / sd, 6) AS p_retailprice, p_type FROM part JOIN f USING (p_size), s""")
def metric_matrix_prep(spark: SparkSession, d: str) -> DataFrame:
    """Features prepared for metrics."""
    m = E.metric_matrix(table(spark, d, "part").select("p_size", "p_retailprice", "p_type"), "p_type")
    return m.select(F.round("p_size", 6).alias("p_size"), F.round("p_retailprice", 6).alias("p_retailprice"), "p_type")


_HASH = "CAST(concat('0x', substr(md5(concat(CAST({k} AS VARCHAR), '#42')), 1, 8)) AS BIGINT) / 4294967296.0"
_RANKED = "(SELECT *, row_number() OVER (PARTITION BY {l} ORDER BY md5(concat(CAST({k} AS VARCHAR), '#42')), {k}) AS rank, count(*) OVER (PARTITION BY {l}) AS size FROM {t})"
_EV = _RANKED.format(l="event_type", k="event_id", t="events")
_OR = _RANKED.format(l="o_orderpriority", k="o_orderkey", t="orders")


@R.add(f"SELECT event_id FROM events WHERE {_HASH.format(k='event_id')} < 0.1")
def hash_fraction_sample(spark: SparkSession, d: str) -> DataFrame:
    """A tenth of the rows, by hash."""
    return A.fraction_sample(table(spark, d, "events"), "event_id", 0.1).select("event_id")


_PICK = "CAST(floor(" + _HASH.format(k="concat({l}, '|', CAST({i} AS VARCHAR))") + " * size) + 1 AS BIGINT)"


@R.add(f"""WITH s AS (SELECT p_type, count(*) AS size FROM part GROUP BY 1), r AS {_RANKED.format(l="p_type", k="p_partkey", t="part")},
d AS (SELECT p_type, size, unnest(range(1, 401)) AS draw FROM s WHERE size < 400), p AS (SELECT p_type, draw, {_PICK.format(l="p_type", i="draw")} AS rank FROM d)
SELECT p_partkey, p_type, 0 AS draw FROM part UNION ALL SELECT r.p_partkey, p.p_type, p.draw FROM p JOIN r ON p.p_type = r.p_type AND p.rank = r.rank""")
def oversample_min(spark: SparkSession, d: str) -> DataFrame:
    """Small classes get the minimum again, drawn with replacement."""
    return A.oversample_min(table(spark, d, "part").select("p_partkey", "p_type"), "p_type", "p_partkey", 400)


@R.add(f"""WITH c AS (SELECT event_type, count(*) AS size FROM events GROUP BY 1), w AS (SELECT *, least(greatest(floor(size * 500 / (SELECT count(*) FROM events)), 20), size) AS want FROM c),
a AS (SELECT event_type, least(greatest(floor(want * least(1.0, 500.0 / (SELECT sum(want) FROM w))), 20), size) AS n FROM w)
SELECT event_id, event_type FROM {_EV} JOIN a USING (event_type) WHERE rank <= n""")
def stratified_budget_sample(spark: SparkSession, d: str) -> DataFrame:
    """A stratified sample of 500 rows or so."""
    return A.stratified_budget(table(spark, d, "events").select("event_id", "event_type"), "event_type", "event_id", 500, 20)


@R.add(f"SELECT f AS fraction, count(*) AS n FROM events, (SELECT unnest([0.01, 0.05, 0.1, 0.25, 0.5, 1.0]) AS f) WHERE {_HASH.format(k='event_id')} < f GROUP BY f")
def fraction_ladder(spark: SparkSession, d: str) -> DataFrame:
    """Nested samples of six fractions."""
    return A.fraction_ladder(table(spark, d, "events"), "event_id", [0.01, 0.05, 0.1, 0.25, 0.5, 1.0]).groupBy("fraction").agg(F.count("*").alias("n"))


_SPLIT = f"(SELECT *, CASE WHEN (rank - 1) / size < 0.6 THEN 'train' WHEN (rank - 1) / size < 0.8 THEN 'validation' ELSE 'test' END AS subset FROM {_OR})"


@R.add(f"SELECT o_orderkey, subset FROM {_SPLIT}")
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    """60 / 20 / 20 within each class."""
    return A.stratified_split(table(spark, d, "orders"), "o_orderpriority", "o_orderkey").select("o_orderkey", "subset")


@R.add(f"SELECT count(*) AS n_shared FROM (SELECT o_orderkey FROM {_SPLIT} GROUP BY o_orderkey HAVING count(DISTINCT subset) > 1)")
def split_disjointness(spark: SparkSession, d: str) -> DataFrame:
    """Keys that two subsets share: none."""
    s = A.stratified_split(table(spark, d, "orders"), "o_orderpriority", "o_orderkey").select("o_orderkey", "subset")
    return s.groupBy("o_orderkey").agg(F.count_distinct("subset").alias("k")).agg(F.count(F.when(F.col("k") > 1, 1)).alias("n_shared"))


@R.add(f"SELECT subset, count(DISTINCT o_orderpriority) AS n_classes, (SELECT count(DISTINCT o_orderpriority) FROM orders) - count(DISTINCT o_orderpriority) AS n_missing FROM {_SPLIT} GROUP BY subset")
def class_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Classes that each subset has and lacks."""
    s = A.stratified_split(table(spark, d, "orders"), "o_orderpriority", "o_orderkey")
    every = s.agg(F.count_distinct("o_orderpriority").alias("all"))
    return s.groupBy("subset").agg(F.count_distinct("o_orderpriority").alias("n_classes")).crossJoin(F.broadcast(every)).select("subset", "n_classes", (F.col("all") - F.col("n_classes")).alias("n_missing"))


@R.add(f"SELECT event_id, event_type FROM {_EV} WHERE rank <= greatest(10, floor(size * 0.1))")
def train_downsample(spark: SparkSession, d: str) -> DataFrame:
    """A tenth of each class, ten rows at least."""
    return A.downsample(table(spark, d, "events").select("event_id", "event_type"), "event_type", "event_id", 0.1, 10)


_BAL = "(SELECT p_brand, count(*) AS size FROM part GROUP BY 1), t AS (SELECT floor(sum(size) / count(*)) AS fair FROM c)"


@R.add(f"WITH c AS {_BAL} SELECT p_brand, size, CAST(least(floor(size * 0.2), greatest(fair - size, 0)) AS BIGINT) AS n FROM c, t")
def oversample_targets(spark: SparkSession, d: str) -> DataFrame:
    """Rows to add to each class."""
    return A.balance_targets(table(spark, d, "part"), "p_brand", 0.2, True)


@R.add(f"WITH c AS {_BAL} SELECT p_brand, size, CAST(greatest(least(size, fair), floor(size * 0.9)) AS BIGINT) AS n FROM c, t")
def undersample_targets(spark: SparkSession, d: str) -> DataFrame:
    """Rows to keep of each class."""
    return A.balance_targets(table(spark, d, "part"), "p_brand", 0.1, False)


@R.add(f"""WITH s AS (SELECT p_type, count(*) AS size FROM part GROUP BY 1), r AS {_RANKED.format(l="p_type", k="p_partkey", t="part")},
d AS (SELECT p_type, size, unnest(range(1, greatest(350 - size, 0) + 1)) AS draw FROM s), p AS (SELECT p_type, draw, {_PICK.format(l="p_type", i="draw")} AS rank FROM d)
SELECT p_type, count(*) AS n, CAST(sum(p_partkey) AS BIGINT) AS keys FROM (SELECT p_type, p_partkey FROM r WHERE rank <= 350 UNION ALL SELECT p.p_type, r.p_partkey FROM p JOIN r ON p.p_type = r.p_type AND p.rank = r.rank) GROUP BY 1""")
def random_resample(spark: SparkSession, d: str) -> DataFrame:
    """Every class brought to 350 rows."""
    x = table(spark, d, "part").select("p_partkey", "p_type")
    targets = x.select("p_type").distinct().withColumn("total", F.lit(350).cast("bigint"))
    return A.resample(x, "p_type", "p_partkey", targets).groupBy("p_type").agg(F.count("*").alias("n"), F.sum("p_partkey").alias("keys"))


@R.add("""WITH c AS (SELECT p_brand, count(*) AS size FROM part GROUP BY 1), t AS (SELECT floor(sum(size) / count(*)) AS fair FROM c),
g AS (SELECT p_brand, size + least(floor(size * 0.5), greatest(fair - size, 0)) AS size FROM c, t), u AS (SELECT floor(sum(size) / count(*)) AS fair FROM g)
SELECT p_brand, CAST(least(size, fair) AS BIGINT) AS n FROM g, u""")
def over_then_under(spark: SparkSession, d: str) -> DataFrame:
    """Oversampled by up to half, then undersampled to the mean."""
    x = A.over_then_under(table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", "p_partkey", 0.5, None)
    return x.groupBy("p_brand").agg(F.count("*").alias("n"))


@R.add(f"SELECT o_orderkey, rank % 5 AS fold FROM {_OR}")
def kfold_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Five stratified folds."""
    return A.folds(table(spark, d, "orders"), "o_orderpriority", "o_orderkey").select("o_orderkey", "fold")


@R.add(f"SELECT event_id, CASE WHEN {_HASH.format(k='event_id')} < 0.2 THEN 'test' ELSE 'train' END AS subset FROM events")
def hash_train_test(spark: SparkSession, d: str) -> DataFrame:
    """80 / 20 by hash."""
    return A.hash_split(table(spark, d, "events"), "event_id").select("event_id", "subset")
