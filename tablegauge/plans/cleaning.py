"""Queries of projections, filters, sets and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import clean as C
from .base import Registry, table

R = Registry()
#: Text-typed numbers of many forms, made from keys in both engines.
_MESSY = "CASE {k} % 6 WHEN 0 THEN CAST({k} AS {t}) WHEN 1 THEN concat(CAST({k} AS {t}), '.5') WHEN 2 THEN concat('0x', CAST({k} % 100 AS {t})) WHEN 3 THEN 'abc' WHEN 4 THEN '' END"
_SUFFIXED = "concat(CAST({k} % 50 AS {t}), CASE {k} % 5 WHEN 0 THEN 'K' WHEN 1 THEN 'M' WHEN 2 THEN '.5G' WHEN 3 THEN '%' ELSE '' END)"


@R.add("SELECT o_orderkey AS key, o_totalprice AS amount, o_orderstatus AS status, NULL AS segment FROM orders UNION ALL SELECT c_custkey, c_acctbal, NULL, c_mktsegment FROM customer")
def scan_union_by_name(spark: SparkSession, d: str) -> DataFrame:
    """Two tables of a kind as one; columns one lacks are null."""
    a = table(spark, d, "orders").selectExpr("o_orderkey AS key", "o_totalprice AS amount", "o_orderstatus AS status")
    return C.union_by_name(a, table(spark, d, "customer").selectExpr("c_custkey AS key", "c_acctbal AS amount", "c_mktsegment AS segment"))


@R.add("SELECT label, count(*) AS n FROM (SELECT concat(l_returnflag, '_', l_linestatus) AS label FROM lineitem) GROUP BY label")
def label_from_concat(spark: SparkSession, d: str) -> DataFrame:
    """A label joined from two columns, and its counts."""
    return table(spark, d, "lineitem").select(F.concat_ws("_", "l_returnflag", "l_linestatus").alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@R.add('SELECT event_id AS "EVENT_ID", user_id AS "USER_ID", value AS "VAL_UE", value * 2 AS "VAL_UE_2", event_type FROM events')
def normalized_columns(spark: SparkSession, d: str) -> DataFrame:
    """Feature names normalised, a clash numbered, the target last."""
    e = table(spark, d, "events").select("event_type", "event_id", F.col("user_id").alias("user-id"), F.col("value").alias("val-ue "), (F.col("value") * 2).alias(" val ue"))
    return C.normalized_columns(C.trimmed_names(e), "event_type")


@R.add("SELECT count(*) AS n_rows, 4 AS n_features, count(DISTINCT l_returnflag) AS n_classes FROM lineitem")
def table_shape(spark: SparkSession, d: str) -> DataFrame:
    """Rows, features and classes of a table."""
    x = table(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
    return x.agg(F.count("*").alias("n_rows"), F.lit(len(x.columns) - 1).alias("n_features"), F.count_distinct("l_returnflag").alias("n_classes"))


@R.add("""SELECT feature, count(*) AS n, round(sum(value), 2) AS total FROM (
  SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS feature, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS value FROM lineitem) GROUP BY feature""")
def long_form_features(spark: SparkSession, d: str) -> DataFrame:
    """Features as rows, summed."""
    x = C.long_form(table(spark, d, "lineitem"), ["l_returnflag"], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return x.groupBy("feature").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@R.add("""SELECT p_partkey, p_type, p_name FROM part""")
def project_and_order(spark: SparkSession, d: str) -> DataFrame:
    """Columns dropped leniently, names trimmed, the target moved last."""
    x = table(spark, d, "part").select(F.col("p_name").alias(" p_name "), "p_partkey", "p_type", "p_brand")
    return C.rightmost(C.trimmed_names(x).drop("p_brand", "missing"), "p_name", "absent")


@R.add("SELECT event_id, value FROM events WHERE event_id % 7 <> 0")
def drop_infinite(spark: SparkSession, d: str) -> DataFrame:
    """Rows without an infinite value."""
    x = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, F.lit(float("inf"))).otherwise(F.col("value")).alias("value"))
    return C.drop_infinite(x)


@R.add("SELECT event_id, value, event_type FROM events WHERE event_id % 5 <> 0 AND event_id % 3 <> 0")
def drop_null_any(spark: SparkSession, d: str) -> DataFrame:
    """Rows without a null."""
    i = F.col("event_id")
    x = table(spark, d, "events").select("event_id", F.when(i % 5 != 0, F.col("value")).alias("value"), F.when(i % 3 != 0, F.col("event_type")).alias("event_type"))
    return x.na.drop("any")


@R.add("""SELECT event_id % 50 AS a, CAST(user_id % 10 AS DOUBLE) AS b FROM events WHERE event_id % 11 <> 0 AND event_id % 13 <> 0 GROUP BY ALL""")
def clean_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Infinite values, empty columns, null rows and repeated rows removed."""
    i = F.col("event_id")
    b = F.when(i % 11 == 0, F.lit(float("inf"))).when(i % 13 == 0, F.lit(float("nan"))).otherwise((F.col("user_id") % 10).cast("double"))
    return C.clean_matrix(table(spark, d, "events").select((i % 50).alias("a"), b.alias("b"), F.lit(None).cast("double").alias("empty")))


@R.add("SELECT DISTINCT text, lang FROM documents")
def drop_duplicates_text(spark: SparkSession, d: str) -> DataFrame:
    """Distinct texts and languages."""
    return table(spark, d, "documents").select("text", "lang").dropDuplicates()


@R.add("SELECT l_quantity, l_discount, count(*) AS multiplicity FROM lineitem GROUP BY ALL")
def dup_multiplicity(spark: SparkSession, d: str) -> DataFrame:
    """Distinct rows with their multiplicity."""
    return C.multiplicity(table(spark, d, "lineitem").select("l_quantity", "l_discount"))


@R.add("SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name HAVING count(*) * 100.0 / (SELECT count(*) FROM customer) > 4")
def keep_frequent_classes(spark: SparkSession, d: str) -> DataFrame:
    """Classes above 4 percent of the rows."""
    x = table(spark, d, "customer").join(table(spark, d, "nation"), F.expr("c_nationkey = n_nationkey"))
    return C.keep_frequent_classes(x, "n_name", 4.0).groupBy("n_name").agg(F.count("*").alias("n"))


@R.add("WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand) SELECT p_brand, n FROM c WHERE n >= (SELECT quantile_cont(n, 0.25) FROM c)")
def keep_by_count_quantile(spark: SparkSession, d: str) -> DataFrame:
    """Classes whose count reaches the lower quartile of counts."""
    return C.keep_by_count_quantile(table(spark, d, "part"), "p_brand", 0.25).groupBy("p_brand").agg(F.count("*").alias("n"))


_MEAN = "(p_size + p_retailprice) / 2"


@R.add(f"""WITH x AS (SELECT p_partkey, p_type, {_MEAN} AS m FROM part), c AS (SELECT p_type, quantile_cont(m, 0.1) AS cut, max(m) AS top FROM x GROUP BY p_type)
SELECT p_partkey, p_type, round(m, 6) AS row_mean FROM x JOIN c USING (p_type)
WHERE m > cut OR (top <= cut AND p_partkey = (SELECT max(p_partkey) FROM x y WHERE y.p_type = x.p_type AND y.m = c.top))""")
def row_mean_filter(spark: SparkSession, d: str) -> DataFrame:
    """Rows above their class's tenth percentile of row means."""
    x = table(spark, d, "part").select("p_partkey", "p_type", S.row_mean("p_size", "p_retailprice").alias("m"))
    return C.row_mean_filter(x, "p_type", "m", "p_partkey", 0.1).select("p_partkey", "p_type", F.round("m", 6).alias("row_mean"))


@R.add("""WITH g AS (SELECT p_brand, sum(p_retailprice) AS gain FROM part GROUP BY p_brand),
o AS (SELECT *, sum(gain) OVER (ORDER BY gain DESC, p_brand ROWS UNBOUNDED PRECEDING) / sum(gain) OVER () AS cumulative FROM g)
SELECT p_brand, round(gain, 4) AS gain, round(cumulative, 6) AS cumulative FROM o WHERE cumulative - gain / (SELECT sum(gain) FROM g) < 0.8 - 1e-12""")
def top_features_by_share(spark: SparkSession, d: str) -> DataFrame:
    """Brands that make up 80 percent of the value, the crossing one included."""
    gains = table(spark, d, "part").groupBy("p_brand").agg(F.sum("p_retailprice").alias("gain"))
    return C.top_by_share(gains, "p_brand", "gain", 0.8 - 1e-12).select("p_brand", F.round("gain", 4).alias("gain"), F.round("cumulative", 6).alias("cumulative"))


@R.add("SELECT event_id, coalesce(CASE WHEN event_id % 4 <> 0 THEN value END, 0.0) AS value, coalesce(CASE WHEN event_id % 6 <> 0 THEN event_type END, '0') AS event_type, coalesce(CASE WHEN event_id % 3 <> 0 THEN user_id END, 0) AS user_id FROM events")
def fill_by_type(spark: SparkSession, d: str) -> DataFrame:
    """Nulls filled by type: 0, 0.0 and '0'."""
    i = F.col("event_id")
    x = table(spark, d, "events").select("event_id", F.when(i % 4 != 0, F.col("value")).alias("value"), F.when(i % 6 != 0, F.col("event_type")).alias("event_type"), F.when(i % 3 != 0, F.col("user_id")).alias("user_id"))
    return x.na.fill(0).na.fill("0")


@R.add("SELECT CASE WHEN o_orderpriority = '5-LOW' THEN 'Benign' ELSE 'Malign' END AS label, count(*) AS n FROM orders GROUP BY 1")
def binarize_label(spark: SparkSession, d: str) -> DataFrame:
    """One priority against the others."""
    return table(spark, d, "orders").select(S.binarize_label(F.col("o_orderpriority"), "5-LOW").alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@R.add("SELECT CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' ELSE o_orderstatus END AS status, count(*) AS n FROM orders GROUP BY 1")
def value_map(spark: SparkSession, d: str) -> DataFrame:
    """Values replaced by a map, others unchanged."""
    return table(spark, d, "orders").select(F.col("o_orderstatus").alias("status")).replace({"O": "open", "F": "filled"}, subset="status").groupBy("status").agg(F.count("*").alias("n"))


@R.add("SELECT event_id, CASE event_id % 6 WHEN 0 THEN event_id WHEN 1 THEN event_id WHEN 2 THEN 16 * ((event_id % 100) // 10) + (event_id % 100) % 10 ELSE 0 END AS number FROM events")
def text_to_int(spark: SparkSession, d: str) -> DataFrame:
    """Integers out of messy texts, 0 where there is none."""
    x = table(spark, d, "events").select("event_id", F.expr(_MESSY.format(k="event_id", t="STRING")).alias("x"))
    return x.select("event_id", S.text_to_int(F.col("x")).alias("number"))


@R.add("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS VARCHAR) ELSE event_type END AS decoded FROM events")
def hex_to_int(spark: SparkSession, d: str) -> DataFrame:
    """Hexadecimal texts as decimal ones."""
    x = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("0x"), F.hex("event_id"))).otherwise(F.col("event_type")).alias("x"))
    return x.select("event_id", S.hex_to_int(F.col("x")).alias("decoded"))


@R.add("SELECT event_id, round((event_id % 50 + CASE event_id % 5 WHEN 2 THEN 0.5 ELSE 0 END) * CASE event_id % 5 WHEN 0 THEN 1e3 WHEN 1 THEN 1e6 WHEN 2 THEN 1e9 WHEN 3 THEN 0.01 ELSE 1.0 END, 6) AS number FROM events")
def kmg_to_number(spark: SparkSession, d: str) -> DataFrame:
    """Numbers with size suffixes."""
    x = table(spark, d, "events").select("event_id", F.expr(_SUFFIXED.format(k="event_id", t="STRING")).alias("x"))
    return x.select("event_id", F.round(S.kmg_to_number(F.col("x")), 6).alias("number"))


@R.add("SELECT page_id, replace(html, '<!DOCTYPE html>', '') AS html FROM pages")
def strip_markup(spark: SparkSession, d: str) -> DataFrame:
    """A markup literal removed from texts."""
    return table(spark, d, "pages").select("page_id", S.strip_markup(F.col("html")).alias("html"))


@R.add("SELECT regexp_replace(o_orderpriority, '[^A-Za-z0-9]', '_', 'g') AS label, count(*) AS n FROM orders GROUP BY 1")
def label_slug(spark: SparkSession, d: str) -> DataFrame:
    """Labels with underscores."""
    return C.slug_labels(table(spark, d, "orders").withColumnRenamed("o_orderpriority", "label"), "label").groupBy("label").agg(F.count("*").alias("n"))


_PORT_SQL = "CASE " + " ".join(f"WHEN p = {k} THEN '{v}'" for k, v in S.PORT_SERVICES.items()) + " WHEN p < 0 OR p > 65535 THEN 'Other' " + " ".join(f"WHEN p <= {k} THEN '{v}'" for k, v in S.PORT_RANGES) + " ELSE 'Other' END"


@R.add(f"SELECT service, count(*) AS n FROM (SELECT {_PORT_SQL} AS service FROM (SELECT CASE WHEN event_id % 9 = 0 THEN NULL ELSE (event_id * 37) % 70000 - 100 END AS p FROM events)) GROUP BY service")
def port_service(spark: SparkSession, d: str) -> DataFrame:
    """Services and ranges of ports made from keys."""
    p = F.when(F.col("event_id") % 9 != 0, (F.col("event_id") * 37) % 70000 - 100)
    return table(spark, d, "events").select(S.port_service(p).alias("service")).groupBy("service").agg(F.count("*").alias("n"))


@R.add("SELECT o_orderkey, CASE WHEN x > 0 THEN CAST(CAST(floor(log10(x)) AS BIGINT) AS VARCHAR) ELSE 'NaN' END AS exponent FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE (o_totalprice - 1000) / 3e8 END AS x FROM orders)")
def latency_exponent(spark: SparkSession, d: str) -> DataFrame:
    """Decimal exponents of small numbers."""
    x = F.when(F.col("o_orderkey") % 8 != 0, (F.col("o_totalprice") - 1000) / 3e8)
    return table(spark, d, "orders").select("o_orderkey", S.latency_exponent(x).alias("exponent"))


@R.add("""WITH s AS (SELECT o_orderpriority AS dataset_id, o_orderstatus AS stage, avg(o_totalprice) AS score FROM orders GROUP BY ALL)
SELECT a.dataset_id, a.stage, round(a.score, 4) AS score, round(a.score - b.score, 4) AS delta, round((a.score - b.score) / b.score * 100, 4) AS delta_percent
FROM s a JOIN s b ON a.dataset_id = b.dataset_id AND b.stage = 'F'""")
def delta_to_baseline(spark: SparkSession, d: str) -> DataFrame:
    """Each stage's score against the baseline stage of its table."""
    s = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("dataset_id"), F.col("o_orderstatus").alias("stage")).agg(F.avg("o_totalprice").alias("score"))
    base = s.where("stage = 'F'").select("dataset_id", F.col("score").alias("base"))
    delta = F.col("score") - F.col("base")
    return s.join(base, "dataset_id").select("dataset_id", "stage", F.round("score", 4).alias("score"), F.round(delta, 4).alias("delta"), F.round(delta / F.col("base") * 100, 4).alias("delta_percent"))


@R.add("""SELECT conv_id, turn, coalesce(trim(replace(text, '.', '')), '-1') AS text, coalesce(CASE WHEN turn % 3 <> 0 THEN turn END, -1) AS turn_or_default,
  regexp_replace(concat(role, ' ', CAST(turn AS VARCHAR)), '\\s\\d+', '', 'g') AS role, TRY_CAST(CASE WHEN turn % 2 = 0 THEN CAST(turn AS VARCHAR) ELSE 'x' END AS DOUBLE) AS number FROM conversations""")
def text_cleanup(spark: SparkSession, d: str) -> DataFrame:
    """Fills per column, trimming, character removal, suffix removal and coercion."""
    t = F.col("turn")
    x = table(spark, d, "conversations").select(
        "conv_id", "turn", F.trim(F.replace("text", F.lit("."), F.lit(""))).alias("text"), F.when(t % 3 != 0, t).alias("turn_or_default"),
        S.strip_trailing_number(F.concat("role", F.lit(" "), t.cast("string"))).alias("role"), F.when(t % 2 == 0, t.cast("string")).otherwise("x").try_cast("double").alias("number"),
    )
    return x.na.fill({"text": "-1", "turn_or_default": -1})


@R.add("SELECT event_id, round_even(value, 3) AS rounded FROM events")
def round_half_even(spark: SparkSession, d: str) -> DataFrame:
    """Halves to the even digit."""
    return table(spark, d, "events").select("event_id", S.round_half_even(F.col("value")).alias("rounded"))


@R.add("SELECT kind, count(*) AS n, round(sum(x), 2) AS total FROM (SELECT 'order' AS kind, o_totalprice AS x FROM orders UNION ALL SELECT 'event', CAST(user_id AS DOUBLE) FROM events) GROUP BY kind")
def union_reinfer(spark: SparkSession, d: str) -> DataFrame:
    """A union as text, numbers inferred again."""
    a = table(spark, d, "orders").select(F.lit("order").alias("kind"), F.col("o_totalprice").cast("string").alias("x"))
    both = C.union_by_name(a, table(spark, d, "events").select(F.lit("event").alias("kind"), F.col("user_id").cast("string").alias("x")))
    from ..operators.profile import numeric_text

    return numeric_text(both).groupBy("kind").agg(F.count("*").alias("n"), F.round(F.sum("x"), 2).alias("total"))
