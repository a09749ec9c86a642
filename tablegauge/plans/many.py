"""Queries over many tables at once and over the result store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import hash_share
from ..functions.stored import shared_path, stored
from ..operators import difficulty as D
from ..operators import many as M
from ..sources import result_store as R_
from .base import Registry, table

R = Registry()

#: Table, key, label, features of the tables that are compared.
TABLES = {
    "lineitem": ("concat_ws('|', l_orderkey, l_linenumber)", "l_returnflag", ("l_quantity", "l_extendedprice", "l_discount", "l_tax")),
    "orders": ("o_orderkey", "o_orderstatus", ("o_totalprice", "o_custkey")),
    "customer": ("c_custkey", "c_mktsegment", ("c_acctbal", "c_nationkey")),
    "part": ("p_partkey", "p_brand", ("p_retailprice", "p_size")),
    "supplier": ("s_suppkey", "s_nationkey", ("s_acctbal",)),
}


def _tables(spark: SparkSession, d: str) -> dict[str, M.Labelled]:
    return {n: M.Labelled(table(spark, d, n).withColumn("__key", F.expr(key).cast("string")), "__key", label, features) for n, (key, label, features) in TABLES.items()}


_STACKED = " UNION ALL ".join(f"SELECT '{n}' AS dataset_id, CAST({key} AS VARCHAR) AS key, CAST({label} AS VARCHAR) AS label, [{', '.join(f'CAST({c} AS DOUBLE)' for c in fs)}] AS x FROM {n}" for n, (key, label, fs) in TABLES.items())
_HALF = " WHERE CAST(concat('0x', substr(md5(concat(key, '#42')), 1, 8)) AS BIGINT) / 4294967296.0 < 0.5"
_LONG = f"""raw AS ({_STACKED}), once AS (SELECT dataset_id, label, x, min(key) AS key FROM raw WHERE label IS NOT NULL AND key IS NOT NULL AND len(list_filter(x, lambda v: v IS NULL OR NOT isfinite(v))) = 0 GROUP BY ALL),
part_rows AS (SELECT * FROM once{_HALF}),
long AS (SELECT dataset_id, key, label, unnest(range(len(x))) AS feature, unnest(x) AS value FROM part_rows),
stats AS (SELECT dataset_id, feature, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std, count(DISTINCT value) AS d FROM long GROUP BY ALL),
shares AS (SELECT dataset_id, feature, value, count(*) AS c FROM long GROUP BY ALL),
prepared AS (SELECT dataset_id, key, label, feature, CASE WHEN d < 200 THEN c / n WHEN std > 0 THEN (value - mean) / std ELSE 0 END AS value FROM long JOIN stats USING (dataset_id, feature) JOIN shares USING (dataset_id, feature, value))"""
_METRICS = f"""{_LONG}, m AS (SELECT dataset_id, label, feature, count(*) AS n, avg(value) AS mean, var_pop(value) * count(*) AS m2 FROM prepared GROUP BY ALL),
g AS (SELECT *, sum(n * mean) OVER (PARTITION BY dataset_id, feature) / sum(n) OVER (PARTITION BY dataset_id, feature) AS grand FROM m),
fs AS (SELECT dataset_id, feature, count(*) AS k, sum(n) AS n, sum(CASE WHEN n > 1 THEN n * power(mean - grand, 2) ELSE 0 END) AS ssb, sum(CASE WHEN n > 1 THEN m2 ELSE 0 END) AS ssw FROM g GROUP BY ALL),
f AS (SELECT dataset_id, avg(CASE WHEN ssw > 0 AND k > 1 AND n > k THEN (ssb / (k - 1)) / (ssw / (n - k)) ELSE 0 END) AS anova_f_mean, CAST(any_value(n) AS BIGINT) AS n_rows, count(*) AS n_features FROM fs GROUP BY 1),
cs AS (SELECT dataset_id, sum(n * power(mean - grand, 2)) AS ssb, sum(m2) AS ssw, count(DISTINCT label) AS k, sum(n) / count(DISTINCT feature) AS n FROM g GROUP BY 1),
c AS (SELECT dataset_id, CASE WHEN ssw > 0 AND k > 1 AND n > k THEN (ssb / (k - 1)) / (ssw / (n - k)) ELSE 0 END AS calinski_harabasz FROM cs),
e AS (SELECT dataset_id, avg(d) AS centroid_distance FROM (SELECT a.dataset_id, sqrt(sum(power(a.mean - b.mean, 2))) AS d FROM m a JOIN m b ON a.dataset_id = b.dataset_id AND a.feature = b.feature AND a.label < b.label GROUP BY a.dataset_id, a.label, b.label) GROUP BY 1),
span AS (SELECT dataset_id, feature, min(value) AS lo, max(value) AS hi FROM prepared GROUP BY ALL),
h AS (SELECT dataset_id, feature, label, CASE WHEN hi > lo THEN least(floor((value - lo) / (hi - lo) * 32), 31) ELSE 0 END AS bin, count(*) AS n FROM prepared JOIN span USING (dataset_id, feature) GROUP BY ALL),
p AS (SELECT dataset_id, feature, n / sum(n) OVER (PARTITION BY dataset_id, feature) AS p, sum(n) OVER (PARTITION BY dataset_id, feature, bin) / sum(n) OVER (PARTITION BY dataset_id, feature) AS x, sum(n) OVER (PARTITION BY dataset_id, feature, label) / sum(n) OVER (PARTITION BY dataset_id, feature) AS y FROM h),
i AS (SELECT dataset_id, avg(s) AS mutual_information_mean FROM (SELECT dataset_id, feature, sum(p * ln(p / (x * y))) AS s FROM p GROUP BY ALL) GROUP BY 1),
b AS (SELECT dataset_id, count(*) AS n_classes, max(n) / min(n) AS imbalance_ratio, CASE WHEN count(*) > 1 THEN -sum(n / t * ln(n / t)) / ln(count(*)) ELSE 1 END AS normalized_entropy FROM (SELECT *, sum(n) OVER (PARTITION BY dataset_id) AS t FROM (SELECT dataset_id, label, count(*) AS n FROM part_rows GROUP BY ALL)) GROUP BY 1),
metrics AS (SELECT * FROM f JOIN i USING (dataset_id) JOIN e USING (dataset_id) JOIN c USING (dataset_id) JOIN b USING (dataset_id))"""
_NUMBERS = ("anova_f_mean", "mutual_information_mean", "centroid_distance", "calinski_harabasz", "imbalance_ratio", "normalized_entropy")


@R.add(f"WITH {_METRICS} SELECT dataset_id, n_rows, n_features, n_classes, {', '.join(f'round({c}, 6) AS {c}' for c in _NUMBERS)} FROM metrics")
def many_tables_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Five tables of different columns cleaned, halved, prepared and measured in one plan."""
    m = M.metrics(M.prepared(M.cleaned(M.stacked(_tables(spark, d)), 0.5), keyed=False))
    return m.select("dataset_id", "n_rows", "n_features", "n_classes", *[F.round(c, 6).alias(c) for c in _NUMBERS])


_ALL = [c for g in M.GROUPS.values() for c in g]
_UNIT = ", ".join(f"CASE WHEN max(v_{c}) OVER () > min(v_{c}) OVER () THEN (v_{c} - min(v_{c}) OVER ()) / (max(v_{c}) OVER () - min(v_{c}) OVER ()) ELSE 0 END AS {c}" for c in _ALL)
_DIFFICULTY = f"""{_METRICS}, turned AS (SELECT dataset_id, {', '.join(f"{'-' if c in M.INVERTED else ''}{c} AS v_{c}" for c in _ALL)} FROM metrics),
unit AS (SELECT dataset_id, {_UNIT} FROM turned), grouped AS (SELECT dataset_id, {', '.join(f"({' + '.join(cs)}) / {len(cs)} AS difficulty_{g}" for g, cs in M.GROUPS.items())} FROM unit)"""


@R.add(f"WITH {_DIFFICULTY.replace(_HALF, '')} SELECT dataset_id, {', '.join(f'round(difficulty_{g}, 6) AS difficulty_{g}' for g in M.GROUPS)}, round(({' + '.join(f'difficulty_{g}' for g in M.GROUPS)}) / 3, 6) AS difficulty, row_number() OVER (ORDER BY dataset_id) - 1 AS position FROM grouped")
def many_tables_difficulty(spark: SparkSession, d: str) -> DataFrame:
    """The difficulty of all rows of the five tables, put into the result store, replaced there, read back and ordered by the store's index."""
    path = shared_path(spark, "results")
    found = M.difficulty(M.metrics(M.prepared(M.cleaned(M.stacked(_tables(spark, d))), keyed=False)))
    R_.put(found.withColumn("difficulty", F.lit(None).cast("double")), path, "difficulty")
    R_.put(found, path, "difficulty")
    R_.write_index(spark, path, f"{path}-index")
    back = R_.get(spark, path, "difficulty")
    out = D.ordered(back, R_.read_index(spark, f"{path}-index").where("kind = 'difficulty'").select("dataset_id", "position"))
    return out.select("dataset_id", *[F.round(c, 6).alias(c) for c in found.columns if c != "dataset_id"], "position")


_SHARES = " UNION ALL ".join(
    f"SELECT dataset_id, {f} AS fraction, max(n) / sum(n) AS majority, sum(n) AS n_rows FROM (SELECT dataset_id, label, CAST(count(*) AS DOUBLE) AS n FROM once WHERE CAST(concat('0x', substr(md5(concat(key, '#42')), 1, 8)) AS BIGINT) / 4294967296.0 < {f} GROUP BY ALL) GROUP BY 1"
    for f in (0.25, 0.75)
)
_SCORED = f"""{_DIFFICULTY}, difficulty AS (SELECT dataset_id, ({' + '.join(f'difficulty_{g}' for g in M.GROUPS)}) / 3 AS y FROM grouped),
scores AS ({_SHARES}), points AS (SELECT fraction, metric, y, x FROM (SELECT fraction, y, unnest(['majority', 'n_rows']) AS metric, unnest([majority, n_rows]) AS x FROM scores JOIN difficulty USING (dataset_id))),
ranks AS (SELECT *, rank() OVER (PARTITION BY fraction, metric ORDER BY x) + (count(*) OVER (PARTITION BY fraction, metric, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY fraction, metric ORDER BY y) + (count(*) OVER (PARTITION BY fraction, metric, y) - 1) / 2 AS ry FROM points),
linear AS (SELECT fraction, metric, corr(x, y) AS pearson, corr(rx, ry) AS spearman FROM ranks GROUP BY ALL),
tau AS (SELECT a.fraction, a.metric, sum(sign(a.x - b.x) * sign(a.y - b.y)) / sqrt(sum(CAST(a.x <> b.x AS INTEGER)) * sum(CAST(a.y <> b.y AS INTEGER))) AS kendall FROM points a JOIN points b ON a.fraction = b.fraction AND a.metric = b.metric GROUP BY ALL)"""


@R.add(f"WITH {_SCORED} SELECT fraction, metric, round(pearson, 6) AS pearson, round(spearman, 6) AS spearman, round(kendall, 6) AS kendall FROM linear JOIN tau USING (fraction, metric)")
def many_tables_correlation(spark: SparkSession, d: str) -> DataFrame:
    """How the difficulty of five tables goes with what a majority vote gets, and with their size, in two samples of them."""
    rows = stored(M.cleaned(M.stacked(_tables(spark, d))), "many-rows")
    share = hash_share(F.col("key"), 42)
    found = M.difficulty(M.metrics(M.prepared(rows.where(share < 0.5), keyed=False)))
    held = F.filter(F.array(F.lit(0.25), F.lit(0.75)), lambda f: share < f)
    counts = rows.select("dataset_id", "label", F.explode(held).alias("fraction")).groupBy("dataset_id", "fraction", "label").agg(F.count("*").cast("double").alias("n"))
    results = counts.groupBy("dataset_id", "fraction").agg((F.max("n") / F.sum("n")).alias("majority"), F.sum("n").alias("n_rows"))
    out = M.related(found, results, ["majority", "n_rows"], "fraction")
    return out.select("fraction", "metric", *[F.round(c, 6).alias(c) for c in ("pearson", "spearman", "kendall")])
