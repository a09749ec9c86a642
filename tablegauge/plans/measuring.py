"""Queries of complexity metrics, composite difficulty, evaluation and cross-table analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import analysis as N
from ..operators import complexity as X
from ..operators import difficulty as D
from ..operators import evaluate as V
from ..operators import gram as G
from ..operators import moments as M
from ..operators import neighbour_sampling as B
from .base import Registry, table

R = Registry()
FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_LONG = "(SELECT l_returnflag AS label, unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS feature, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS x FROM lineitem)"
_MOMENTS = f"m AS (SELECT label, feature, count(x) AS n, avg(x) AS mean, var_pop(x) * count(x) AS m2 FROM {_LONG} GROUP BY ALL), g AS (SELECT feature, sum(n * mean) / sum(n) AS grand, count(*) AS k, sum(n) AS total FROM m GROUP BY feature)"
_F = "(sum(n * power(mean - grand, 2)) / (any_value(k) - 1)) / (sum(m2) / (any_value(total) - any_value(k)))"
_CENTROIDS = "c AS (SELECT a.label AS la, b.label AS lb, sqrt(sum(power(a.mean - b.mean, 2))) AS d FROM m a JOIN m b ON a.feature = b.feature AND a.label < b.label GROUP BY ALL)"
_IMBALANCE = "(SELECT count(*) AS k, max(n) / min(n) AS ratio, -sum(n / t * ln(n / t)) / ln(count(*)) AS h FROM (SELECT count(*) AS n, sum(count(*)) OVER () AS t FROM lineitem GROUP BY l_returnflag))"


@R.add(f"""WITH lineitem AS (SELECT DISTINCT l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag FROM lineitem), {_MOMENTS}, {_CENTROIDS}
SELECT 'anova_f' AS metric, feature AS sub_metric, round({_F}, 6) AS value FROM m JOIN g USING (feature) GROUP BY feature
UNION ALL SELECT 'calinski_harabasz', 'score', round((sum(n * power(mean - grand, 2)) / (any_value(k) - 1)) / (sum(m2) / (any_value(total) - any_value(k))), 6) FROM m JOIN g USING (feature)
UNION ALL SELECT 'centroid_distance', 'mean', round(avg(d), 6) FROM c
UNION ALL SELECT 'class_imbalance', unnest(['n_classes', 'imbalance_ratio', 'normalized_entropy']), round(unnest([k, ratio, h]), 6) FROM {_IMBALANCE}""")
def complexity_slice(spark: SparkSession, d: str) -> DataFrame:
    """Relevance, structure and imbalance of one table, from one pass of class moments."""
    df = table(spark, d, "lineitem").select(*FEATURES, "l_returnflag").na.drop("any").dropDuplicates()
    return X.metric_record(df, "l_returnflag", FEATURES).select("metric", "sub_metric", F.round("value", 6).alias("value"))


@R.add(f"WITH {_MOMENTS} SELECT feature, round({_F}, 6) AS f FROM m JOIN g USING (feature) GROUP BY feature")
def anova_f(spark: SparkSession, d: str) -> DataFrame:
    """F of every feature."""
    return X.anova_f(M.class_moments(table(spark, d, "lineitem"), "l_returnflag", FEATURES)).select("feature", F.round("f", 6).alias("f"))


@R.add(f"WITH {_MOMENTS} SELECT round((sum(n * power(mean - grand, 2)) / (any_value(k) - 1)) / (sum(m2) / (any_value(total) - any_value(k))), 6) AS calinski_harabasz FROM m JOIN g USING (feature)")
def calinski_harabasz(spark: SparkSession, d: str) -> DataFrame:
    """Between- over within-class scatter."""
    return X.calinski_harabasz(M.class_moments(table(spark, d, "lineitem"), "l_returnflag", FEATURES)).select(F.round("calinski_harabasz", 6).alias("calinski_harabasz"))


@R.add("""WITH l AS (SELECT label, unnest(range(1, 65)) AS i, unnest(embedding) AS x FROM embeddings), m AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS mean FROM l GROUP BY ALL)
SELECT round(avg(d), 6) AS centroid_distance FROM (SELECT sqrt(sum(power(a.mean - b.mean, 2))) AS d FROM m a JOIN m b ON a.i = b.i AND a.label < b.label GROUP BY a.label, b.label)""")
def centroid_distance(spark: SparkSession, d: str) -> DataFrame:
    """Mean distance of class centroids, which full-rank principal components leave unchanged."""
    return X.centroid_distance(M.array_moments(table(spark, d, "embeddings"), "label", "embedding")).select(F.round("centroid_distance", 6).alias("centroid_distance"))


@R.add(f"""WITH r AS (SELECT feature, min(x) AS lo, max(x) AS hi FROM {_LONG} GROUP BY 1),
h AS (SELECT feature, label, CASE WHEN hi > lo THEN least(floor((x - lo) / (hi - lo) * 64), 63) ELSE 0 END AS bin, count(*) AS n FROM {_LONG} JOIN r USING (feature) GROUP BY ALL),
p AS (SELECT feature, n / sum(n) OVER (PARTITION BY feature) AS p, sum(n) OVER (PARTITION BY feature, bin) / sum(n) OVER (PARTITION BY feature) AS x, sum(n) OVER (PARTITION BY feature, label) / sum(n) OVER (PARTITION BY feature) AS y FROM h)
SELECT feature, round(sum(p * ln(p / (x * y))), 6) AS mutual_information FROM p GROUP BY feature""")
def mutual_information(spark: SparkSession, d: str) -> DataFrame:
    """Histogram mutual information of every feature."""
    h = M.histogram(table(spark, d, "lineitem"), "l_returnflag", FEATURES, 64)
    return X.mutual_information(h).select("feature", F.round("mutual_information", 6).alias("mutual_information"))


@R.add("SELECT n_name, count(*) AS n_classes, round(max(n) / min(n), 6) AS imbalance_ratio, round(CASE WHEN count(*) > 1 THEN -sum(n / t * ln(n / t)) / ln(count(*)) ELSE 1 END, 6) AS normalized_entropy FROM (SELECT n_name, c_mktsegment, count(*) AS n, sum(count(*)) OVER (PARTITION BY n_name) AS t FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, c_mktsegment) GROUP BY n_name")
def class_imbalance(spark: SparkSession, d: str) -> DataFrame:
    """Imbalance of many tables (nations) in one job."""
    x = table(spark, d, "customer").join(table(spark, d, "nation"), F.expr("c_nationkey = n_nationkey"))
    return X.class_imbalance(x, "c_mktsegment", "n_name").select("n_name", "n_classes", F.round("imbalance_ratio", 6).alias("imbalance_ratio"), F.round("normalized_entropy", 6).alias("normalized_entropy"))


def _distance_sql(names: list[str]) -> str:
    """DuckDB's Mahalanobis distances ``x`` of lineitem's rows: a Cholesky factor of each class's covariance, forward substitution."""
    p = range(len(names))
    cov = [f"covar_samp({names[i]}, {names[j]}) {'+ 1e-6' if i == j else ''} AS c{i}{j}" for i in p for j in range(i + 1)]
    steps = ["s AS (SELECT l_returnflag AS label, " + ", ".join([*cov, *[f"avg({n}) AS m{i}" for i, n in enumerate(names)]]) + " FROM lineitem GROUP BY 1)"]
    last = "s"
    for j in p:
        inner = lambda i: "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))  # noqa: E731, B023
        steps.append(f"d{j} AS (SELECT *, sqrt(c{j}{j}{inner(j)}) AS l{j}{j} FROM {last})")
        steps.append(f"f{j} AS (SELECT *" + "".join(f", (c{i}{j}{inner(i)}) / l{j}{j} AS l{i}{j}" for i in range(j + 1, len(names))) + f" FROM d{j})")
        last = f"f{j}"
    rows = f"(SELECT f.*, {', '.join(f'CAST({n} AS DOUBLE) - m{i} AS e{i}' for i, n in enumerate(names))} FROM lineitem JOIN {last} f ON l_returnflag = label)"
    for i in p:
        rows = f"(SELECT *, (e{i}{''.join(f' - l{i}{k} * y{k}' for k in range(i))}) / l{i}{i} AS y{i} FROM {rows})"
    return "WITH " + ", ".join(steps) + f", x AS (SELECT sqrt({' + '.join(f'y{i} * y{i}' for i in p)}) AS x FROM {rows})"


_TEN = "SELECT count(x) AS size, round(max(x), 6) AS max, round(min(x), 6) AS min, round(avg(x), 6) AS mean, round(median(x), 6) AS median, round(quantile_cont(x, 0.25), 6) AS q1, round(quantile_cont(x, 0.75), 6) AS q3, round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 6) AS iqr, round(stddev_pop(x), 6) AS std, round(var_pop(x), 6) AS variance FROM x"


@R.add(_distance_sql(FEATURES) + _TEN)
def mahalanobis_summary(spark: SparkSession, d: str) -> DataFrame:
    """Ten statistics of rows' distances to their class means."""
    x = X.mahalanobis(table(spark, d, "lineitem"), "l_returnflag", FEATURES)
    return x.select("size", *[F.round(c, 6).alias(c) for c in x.columns if c != "size"])


@R.add("""WITH l AS (SELECT label, unnest(range(64)) AS i, unnest(embedding) AS x, vec_id FROM embeddings), m AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS mean, count(*) AS n FROM l GROUP BY ALL),
d AS (SELECT l.label, l.i, vec_id, CAST(x AS DOUBLE) - mean AS x, n FROM l JOIN m ON l.label = m.label AND l.i = m.i)
SELECT a.label, CAST(a.i AS INTEGER) AS a, CAST(b.i AS INTEGER) AS b, round(sum(a.x * b.x) / (any_value(a.n) - 1), 8) AS covariance FROM d a JOIN d b ON a.vec_id = b.vec_id AND a.label = b.label AND a.i <= b.i GROUP BY ALL""")
def wide_covariance(spark: SparkSession, d: str) -> DataFrame:
    """Covariances of 64 columns for each class."""
    names = [f"x{i}" for i in range(64)]
    e = table(spark, d, "embeddings").select("label", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)])
    return G.covariances(e, "label", names).select("label", "a", "b", F.round("covariance", 8).alias("covariance"))


@R.add()
def svm_margin(spark: SparkSession, d: str) -> DataFrame:
    """Ten statistics of support-vector margins."""
    return X.svm_margin(table(spark, d, "lineitem").select(*FEATURES, "l_returnflag"), "l_returnflag", FEATURES)


@R.add()
def svm_margin_signed(spark: SparkSession, d: str) -> DataFrame:
    """Ten statistics of the margins with their sides: rows on the wrong side are below zero."""
    return X.svm_margin(table(spark, d, "lineitem").select(*FEATURES, "l_returnflag"), "l_returnflag", FEATURES, signed=True)


@R.add()
def proba_entropy(spark: SparkSession, d: str) -> DataFrame:
    """Ten statistics of the entropy of logistic probabilities."""
    return X.probability_entropy(table(spark, d, "lineitem").select(*FEATURES, "l_returnflag"), "l_returnflag", FEATURES)


@R.add()
def intrinsic_dimension(spark: SparkSession, d: str) -> DataFrame:
    """Principal components that hold 95 percent of the variance."""
    e = table(spark, d, "embeddings")
    k, percent = X.intrinsic_dimension(e.select(*[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(64)]), [f"x{i}" for i in range(64)])
    return e.agg(F.count("*").alias("n_rows")).select("n_rows", F.lit(k).alias("components"), F.lit(percent).alias("percent"))


_NN = """e AS (SELECT vec_id, label, unnest(range(1, 65)) AS i, unnest(embedding) AS x FROM embeddings),
p AS (SELECT a.vec_id AS key, a.label AS label, b.vec_id AS other, b.label AS other_label, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda t: power(CAST(t[1] AS DOUBLE) - CAST(t[2] AS DOUBLE), 2)))) AS distance FROM embeddings a, embeddings b),
n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY distance, other) AS rank FROM p WHERE key <> other)"""


def _near(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    return X.nearest(rows, "vec_id", "label", "embedding", X.neighbour_count(rows.count()))


_K = "(SELECT greatest(2, CAST(floor(sqrt(count(*))) AS INTEGER)) FROM embeddings)"


@R.add(f"WITH {_NN} SELECT key, round(avg(CASE WHEN label <> other_label THEN 1 ELSE 0 END), 6) AS kdn FROM n WHERE rank <= {_K} GROUP BY key")
def kdn(spark: SparkSession, d: str) -> DataFrame:
    """Share of disagreeing neighbours of every row."""
    return X.kdn(_near(spark, d)).select("key", F.round("kdn", 6).alias("kdn"))


@R.add(f"WITH {_NN} SELECT key, round(min(distance), 6) AS distance FROM p WHERE label <> other_label GROUP BY key")
def nearest_enemy(spark: SparkSession, d: str) -> DataFrame:
    """Distance to the nearest of all rows of another class."""
    return X.nearest_enemy(table(spark, d, "embeddings"), "vec_id", "label", "embedding").select("key", F.round("distance", 6).alias("distance"))


@R.add(f"""WITH {_NN}, s AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY distance, other) AS r FROM p),
v AS (SELECT key, label, other_label, count(*) AS c FROM s WHERE r <= {_K} GROUP BY ALL), w AS (SELECT key, label, arg_max(other_label, (c, -other_label)) AS vote FROM v GROUP BY ALL)
SELECT round(1 - avg(CASE WHEN vote = label THEN 1 ELSE 0 END), 6) AS knn_overlap FROM w""")
def knn_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Error of a neighbours' vote on its own rows."""
    rows = table(spark, d, "embeddings")
    return X.knn_overlap(rows, "vec_id", "label", "embedding", X.neighbour_count(rows.count())).select(F.round("knn_overlap", 6).alias("knn_overlap"))


@R.add(f"""WITH {_NN}, q AS (SELECT key, label, other_label, avg(power(distance, 2)) FILTER (WHERE key <> other) AS m FROM p GROUP BY ALL),
ab AS (SELECT key, max(CASE WHEN label = other_label THEN m END) AS a, min(CASE WHEN label <> other_label THEN m END) AS b FROM q GROUP BY key)
SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM ab""")
def silhouette(spark: SparkSession, d: str) -> DataFrame:
    """Mean silhouette of the true classes, squared distance."""
    return X.silhouette(table(spark, d, "embeddings"), "label", "embedding").select(F.round("silhouette", 6).alias("silhouette"))


@R.add(f"WITH {_NN}, o AS (SELECT key, other FROM n WHERE rank = 1 AND label <> other_label) SELECT a.key, a.other FROM o a JOIN o b ON a.key = b.other AND a.other = b.key WHERE a.key < a.other")
def tomek_links(spark: SparkSession, d: str) -> DataFrame:
    """Mutual nearest neighbours of different classes."""
    return B.tomek_links(table(spark, d, "embeddings"), "vec_id", "label", "embedding")


_H = "CAST(concat('0x', substr(md5(concat(CAST(label AS VARCHAR), '{t}', CAST(draw AS VARCHAR), '#42')), 1, 8)) AS BIGINT) / 4294967296.0"


@R.add(f"""WITH {_NN}, z AS (SELECT label, count(*) AS size FROM embeddings GROUP BY 1), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat(CAST(vec_id AS VARCHAR), '#42')), vec_id) AS rank FROM embeddings),
d AS (SELECT label, size, unnest(range(1, 11)) AS draw FROM z), g AS (SELECT *, floor({_H.format(t="|b|")} * size) + 1 AS rank, floor({_H.format(t="|n|")} * least(5, size - 1)) + 1 AS pick, {_H.format(t="|t|")} AS pos FROM d),
w AS (SELECT key, other, row_number() OVER (PARTITION BY key ORDER BY distance, other) AS pick FROM p WHERE key <> other AND label = other_label)
SELECT g.label, g.draw, k.vec_id AS base, w.other AS neighbour, round(k.embedding[1] + (CAST(u.embedding[1] AS DOUBLE) - CAST(k.embedding[1] AS DOUBLE)) * pos, 6) AS first_value
FROM g JOIN k ON g.label = k.label AND g.rank = k.rank JOIN w ON w.key = k.vec_id AND w.pick = g.pick JOIN embeddings u ON u.vec_id = w.other""")
def smote_rows(spark: SparkSession, d: str) -> DataFrame:
    """Ten synthetic rows a class."""
    e = table(spark, d, "embeddings")
    wanted = e.select("label").distinct().withColumn("n", F.lit(10))
    return B.smote(e, "vec_id", "label", "embedding", wanted).select("label", "draw", "base", "neighbour", F.round(F.col("vector")[0], 6).alias("first_value"))


@R.add(f"""WITH e AS (SELECT p_partkey AS key, p_type AS label, CAST(p_retailprice AS DOUBLE) AS x, CAST(p_size AS DOUBLE) AS y, p_name AS c, p_brand AS b FROM part),
m AS (SELECT label, power((stddev_pop(x) + stddev_pop(y)) / 2, 2) AS weight, count(*) AS size FROM e GROUP BY 1),
k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat(CAST(key AS VARCHAR), '#42')), key) AS rank FROM e),
d AS (SELECT label, size, unnest(range(1, 21)) AS draw FROM m), g AS (SELECT *, floor({_H.format(t="|b|")} * size) + 1 AS rank, floor({_H.format(t="|n|")} * least(5, size - 1)) + 1 AS pick, {_H.format(t="|t|")} AS pos FROM d),
q AS (SELECT g.label, g.draw, g.pick, g.pos, k.key, k.x, k.y, k.c, k.b FROM g JOIN k ON g.label = k.label AND g.rank = k.rank),
p AS (SELECT q.label, q.draw, q.pick, q.pos, q.key, q.x, q.y, o.key AS other, o.x AS ox, o.y AS oy, o.c AS oc, o.b AS ob,
  sqrt(power(q.x - o.x, 2) + power(q.y - o.y, 2) + weight * (CAST(q.c <> o.c AS INTEGER) + CAST(q.b <> o.b AS INTEGER))) AS distance FROM q JOIN m USING (label) JOIN e o ON o.label = q.label AND o.key <> q.key),
n AS (SELECT *, row_number() OVER (PARTITION BY label, draw ORDER BY distance, other) AS place FROM p QUALIFY place <= 5),
c AS (SELECT *, row_number() OVER (PARTITION BY label, draw ORDER BY t DESC, oc) AS r FROM (SELECT label, draw, oc, count(*) AS t FROM n GROUP BY ALL)), b AS (SELECT *, row_number() OVER (PARTITION BY label, draw ORDER BY t DESC, ob) AS r FROM (SELECT label, draw, ob, count(*) AS t FROM n GROUP BY ALL))
SELECT n.label AS p_type, n.draw, key AS base, other AS neighbour, round(x + (ox - x) * pos, 6) AS price, round(y + (oy - y) * pos, 6) AS size, c.oc AS name, b.ob AS brand
FROM n JOIN c ON n.label = c.label AND n.draw = c.draw AND c.r = 1 JOIN b ON n.label = b.label AND n.draw = b.draw AND b.r = 1 WHERE place = pick""")
def smote_mixed_rows(spark: SparkSession, d: str) -> DataFrame:
    """Twenty synthetic parts a type, of numbers and categories."""
    p = table(spark, d, "part")
    wanted = p.select("p_type").distinct().withColumn("n", F.lit(20))
    made = B.smote_mixed(p, "p_partkey", "p_type", ["p_retailprice", "p_size"], ["p_name", "p_brand"], wanted)
    n, c = F.col("numbers"), F.col("categories")
    return made.select("p_type", "draw", "base", "neighbour", F.round(n[0], 6).alias("price"), F.round(n[1], 6).alias("size"), c["p_name"].alias("name"), c["p_brand"].alias("brand"))


@R.add(f"""WITH {_NN}, o AS (SELECT key, other, label, other_label FROM n WHERE rank = 1 AND label <> other_label), t AS (SELECT a.* FROM o a JOIN o b ON a.key = b.other AND a.other = b.key),
c AS (SELECT label, count(*) AS k FROM embeddings GROUP BY 1), x AS (SELECT t.key FROM t JOIN c a ON t.label = a.label JOIN c b ON t.other_label = b.label WHERE a.k >= b.k)
SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT key FROM x)""")
def tomek_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Rows that Tomek cleaning keeps."""
    return B.without_tomek(table(spark, d, "embeddings"), "vec_id", "label", "embedding").select("vec_id", "label")


_SYNTHETIC = f"""p AS (SELECT a.vec_id AS key, a.label AS label, b.vec_id AS other, b.label AS other_label, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda t: power(CAST(t[1] AS DOUBLE) - CAST(t[2] AS DOUBLE), 2)))) AS distance FROM embeddings a, embeddings b),
z AS (SELECT label, count(*) AS size FROM embeddings GROUP BY 1), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat(CAST(vec_id AS VARCHAR), '#42')), vec_id) AS rank FROM embeddings),
d AS (SELECT label, size, unnest(range(1, 6)) AS draw FROM z), g AS (SELECT *, floor({_H.format(t="|b|")} * size) + 1 AS rank, floor({_H.format(t="|n|")} * least(5, size - 1)) + 1 AS pick, {_H.format(t="|t|")} AS pos FROM d),
w AS (SELECT key, other, row_number() OVER (PARTITION BY key ORDER BY distance, other) AS pick FROM p WHERE key <> other AND label = other_label),
made AS (SELECT -CAST(concat('0x', substr(md5(concat(CAST(g.label AS VARCHAR), '|', CAST(g.draw AS VARCHAR))), 1, 15)) AS BIGINT) - 1 AS vec_id, g.label, list_transform(list_zip(k.embedding, u.embedding), lambda t: CAST(t[1] AS DOUBLE) + (CAST(t[2] AS DOUBLE) - CAST(t[1] AS DOUBLE)) * pos) AS v
  FROM g JOIN k ON g.label = k.label AND g.rank = k.rank JOIN w ON w.key = k.vec_id AND w.pick = g.pick JOIN embeddings u ON u.vec_id = w.other),
every AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings UNION ALL SELECT * FROM made)"""


@R.add(f"""WITH {_SYNTHETIC}, q AS (SELECT a.vec_id AS key, a.label, b.vec_id AS other, b.label AS other_label, row_number() OVER (PARTITION BY a.vec_id ORDER BY sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda t: power(t[1] - t[2], 2)))), b.vec_id) AS rank FROM every a JOIN every b ON a.vec_id <> b.vec_id),
o AS (SELECT key, other, label, other_label FROM q WHERE rank = 1 AND label <> other_label), t AS (SELECT a.* FROM o a JOIN o b ON a.key = b.other AND a.other = b.key),
c AS (SELECT label, count(*) AS n FROM every GROUP BY 1), x AS (SELECT t.key FROM t JOIN c a ON t.label = a.label JOIN c b ON t.other_label = b.label WHERE a.n >= b.n)
SELECT vec_id, label, round(v[1], 6) AS first_value FROM every WHERE vec_id NOT IN (SELECT key FROM x)""")
def smote_tomek(spark: SparkSession, d: str) -> DataFrame:
    """Synthetic rows added, then Tomek links cleaned."""
    e = table(spark, d, "embeddings")
    wanted = e.select("label").distinct().withColumn("n", F.lit(5))
    return B.smote_tomek(e, "vec_id", "label", "embedding", wanted).select("vec_id", "label", F.round(F.col("embedding")[0], 6).alias("first_value"))


@R.add(f"WITH {_MOMENTS} SELECT 'anova_f' AS metric, feature AS sub_metric, round({_F}, 6) AS value, 'ok' AS status FROM m JOIN g USING (feature) GROUP BY feature UNION ALL SELECT 'anova_f', 'absent', NULL, 'missing'")
def metric_validation(spark: SparkSession, d: str) -> DataFrame:
    """Expected metrics that are there, missing, or not numbers."""
    df = table(spark, d, "lineitem")
    got = X.metric_record(df, "l_returnflag", FEATURES)
    expected = spark.createDataFrame([("anova_f", s) for s in [*FEATURES, "absent"]], "metric string, sub_metric string")
    return X.validated(got, expected).select("metric", "sub_metric", F.round("value", 6).alias("value"), "status")


# --- classification metrics over a nearest-centroid model -------------------------------------------

_PRED = """e AS (SELECT vec_id, label, unnest(range(1, 65)) AS i, unnest(embedding) AS x FROM embeddings), m AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS c FROM e GROUP BY ALL),
dd AS (SELECT e.vec_id AS key, e.label AS y, m.label AS label, sqrt(sum(power(CAST(x AS DOUBLE) - c, 2))) AS d FROM e JOIN m USING (i) GROUP BY ALL),
pr AS (SELECT key, y, label, d, exp(min(d) OVER (PARTITION BY key) - d) AS w, first_value(label) OVER (PARTITION BY key ORDER BY d, label) AS yhat FROM dd),
pp AS (SELECT key, y, label, yhat, w / sum(w) OVER (PARTITION BY key) AS p FROM pr), one AS (SELECT DISTINCT key, y, yhat FROM pp), cm AS (SELECT y, yhat, count(*) AS n FROM one GROUP BY ALL)"""


def _proba(spark: SparkSession, d: str) -> DataFrame:
    return V.nearest_centroid(table(spark, d, "embeddings"), "vec_id", "label", "embedding")


def _pred(spark: SparkSession, d: str) -> DataFrame:
    return _proba(spark, d).where("label = y").select("key", "y", "yhat")


@R.add(f"WITH {_PRED} SELECT key, y, yhat FROM one")
def nearest_centroid_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Predicted classes."""
    return _pred(spark, d)


@R.add(f"WITH {_PRED}, l AS (SELECT DISTINCT label FROM embeddings) SELECT a.label AS y, b.label AS yhat, coalesce(n, 0) AS n FROM l a CROSS JOIN l b LEFT JOIN cm ON cm.y = a.label AND cm.yhat = b.label")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    """All cells of the confusion matrix."""
    return V.full_confusion(V.confusion(_pred(spark, d)))


_PC = """pc AS (SELECT label, tp, support, predicted, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS pre, tp / support AS rec FROM
  (SELECT l.label, coalesce((SELECT sum(n) FROM cm WHERE y = l.label AND yhat = l.label), 0) AS tp, (SELECT sum(n) FROM cm WHERE y = l.label) AS support, coalesce((SELECT sum(n) FROM cm WHERE yhat = l.label), 0) AS predicted FROM (SELECT DISTINCT label FROM embeddings) l)),
pf AS (SELECT *, CASE WHEN pre + rec > 0 THEN 2 * pre * rec / (pre + rec) ELSE 0 END AS f1 FROM pc)"""


@R.add(f"""WITH {_PRED}, {_PC}, a AS (SELECT sum(tp) AS c, CAST(sum(support) AS DOUBLE) AS s, CAST(sum(support * predicted) AS DOUBLE) AS x, CAST(sum(support * support) AS DOUBLE) AS tt, CAST(sum(predicted * predicted) AS DOUBLE) AS q, avg(rec) AS bal,
  avg(pre) AS mp, avg(rec) AS mr, avg(f1) AS mf, sum(pre * support) / sum(support) AS wp, sum(rec * support) / sum(support) AS wr, sum(f1 * support) / sum(support) AS wf FROM pf)
SELECT unnest(['accuracy', 'balanced_accuracy', 'matthews', 'kappa', 'micro_precision', 'micro_recall', 'micro_f1', 'macro_precision', 'macro_recall', 'macro_f1', 'weighted_precision', 'weighted_recall', 'weighted_f1']) AS metric,
  round(unnest([c / s, bal, (c * s - x) / sqrt((s * s - q) * (s * s - tt)), (c / s - x / (s * s)) / (1 - x / (s * s)), c / s, c / s, c / s, mp, mr, mf, wp, wr, wf]), 6) AS value FROM a""")
def classification_report(spark: SparkSession, d: str) -> DataFrame:
    """Thirteen scores of the predictions."""
    return V.report(V.confusion(_pred(spark, d))).select("metric", F.round("value", 6).alias("value"))


@R.add(f"WITH {_PRED} SELECT round(avg(-ln(least(greatest(p, 1e-15), 1 - 1e-15))), 6) AS log_loss FROM pp WHERE label = y")
def log_loss(spark: SparkSession, d: str) -> DataFrame:
    """Mean negative log probability of the true class."""
    return V.log_loss(_proba(spark, d)).select(F.round("log_loss", 6).alias("log_loss"))


_AREA = "CASE WHEN pos > 0 AND n > pos THEN (ranks - pos * (pos + 1) / 2) / (pos * (n - pos)) END"


@R.add(f"""WITH {_PRED}, k AS (SELECT label, y, rank() OVER (PARTITION BY label ORDER BY p) + (count(*) OVER (PARTITION BY label, p) - 1) / 2 AS r FROM pp),
s AS (SELECT label, sum(CAST(y = label AS INT)) AS pos, count(*) AS n, sum(r * CAST(y = label AS INT)) AS ranks FROM k GROUP BY 1), u AS (SELECT *, {_AREA} AS auc FROM s),
j AS (SELECT y, label, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS r FROM pp), t AS (SELECT sum(CAST(y = label AS INT)) AS pos, count(*) AS n, sum(r * CAST(y = label AS INT)) AS ranks FROM j)
SELECT 'macro' AS average, round(avg(auc), 6) AS auc FROM u UNION ALL SELECT 'weighted', round(sum(auc * pos) / sum(pos), 6) FROM u UNION ALL SELECT 'micro', round({_AREA}, 6) FROM t""")
def roc_auc_ovr(spark: SparkSession, d: str) -> DataFrame:
    """Areas under one-vs-rest curves."""
    return V.auc_one_vs_rest(_proba(spark, d)).select("average", F.round("auc", 6).alias("auc"))


@R.add(f"""WITH {_PRED}, o AS (SELECT pp.label, l.label AS other, y, p FROM pp JOIN (SELECT DISTINCT label FROM embeddings) l ON l.label <> pp.label AND y IN (pp.label, l.label)),
k AS (SELECT *, rank() OVER (PARTITION BY label, other ORDER BY p) + (count(*) OVER (PARTITION BY label, other, p) - 1) / 2 AS r FROM o),
s AS (SELECT label, other, sum(CAST(y = label AS INT)) AS pos, count(*) AS n, sum(r * CAST(y = label AS INT)) AS ranks FROM k GROUP BY ALL), u AS (SELECT *, {_AREA} AS auc FROM s)
SELECT 'macro' AS average, round(avg(auc), 6) AS auc FROM u UNION ALL SELECT 'weighted', round(sum(auc * n) / sum(n), 6) FROM u""")
def roc_auc_ovo(spark: SparkSession, d: str) -> DataFrame:
    """Areas under one-vs-one curves."""
    return V.auc_one_vs_one(_proba(spark, d)).select("average", F.round("auc", 6).alias("auc"))


@R.add(f"""WITH {_PRED}, c AS (SELECT y, yhat, sum(1.0 + key % 3) AS n FROM one GROUP BY ALL), l AS (SELECT DISTINCT y AS label FROM c),
x AS (SELECT label, coalesce((SELECT sum(n) FROM c WHERE y = label AND yhat = label), 0) AS tp, (SELECT sum(n) FROM c WHERE y = label) AS s, coalesce((SELECT sum(n) FROM c WHERE yhat = label), 0) AS q FROM l)
SELECT round(sum(CASE WHEN tp > 0 THEN 2 * tp / (s + q) ELSE 0 END * s) / sum(s), 6) AS weighted_f1 FROM x""")
def weighted_f1(spark: SparkSession, d: str) -> DataFrame:
    """F1 with row weights."""
    p = _pred(spark, d).withColumn("weight", 1.0 + F.col("key") % 3)
    return V.weighted_f1(p, "weight").select(F.round("weighted_f1", 6).alias("weighted_f1"))


@R.add(f"WITH {_PRED}, c AS (SELECT y, n / sum(n) OVER (PARTITION BY y) AS p FROM cm), h AS (SELECT y, sum(-p * ln(p + 1e-10)) AS h FROM c GROUP BY y) SELECT round(avg(h), 6) AS confusion_entropy FROM h")
def confusion_entropy(spark: SparkSession, d: str) -> DataFrame:
    """Mean entropy of the confusion matrix's rows."""
    return X.confusion_entropy(V.confusion(_pred(spark, d))).select(F.round("confusion_entropy", 6).alias("confusion_entropy"))


@R.add(f"WITH {_PRED} SELECT key, round(sum(-p * ln(p + 1e-10)), 6) AS entropy FROM pp GROUP BY key")
def probability_entropy(spark: SparkSession, d: str) -> DataFrame:
    """Entropy of every row's probabilities."""
    return _proba(spark, d).groupBy("key").agg(F.round(S.entropy(F.collect_list("p")), 6).alias("entropy"))


# --- trials: orders as synthetic configurations ------------------------------------------------------

_TRIALS = "(SELECT o_orderpriority AS dataset_id, o_orderkey AS number, o_totalprice AS latency, 1 - CAST(o_custkey % 97 AS DOUBLE) / 97 AS f1 FROM orders)"


def _trials(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").selectExpr("o_orderpriority AS dataset_id", "o_orderkey AS number", "o_totalprice AS latency", "1 - cast(o_custkey % 97 as double) / 97 AS f1")


@R.add(f"SELECT * FROM {_TRIALS} a WHERE NOT EXISTS (SELECT 1 FROM {_TRIALS} b WHERE a.dataset_id = b.dataset_id AND b.f1 >= a.f1 AND b.latency <= a.latency AND (b.f1 > a.f1 OR b.latency < a.latency))")
def pareto_front(spark: SparkSession, d: str) -> DataFrame:
    """Trials that no other beats in both cost and score."""
    return V.pareto_front(_trials(spark, d), "latency", "f1", "dataset_id")


@R.add(f"""WITH t AS (SELECT *, 0.5 * (f1 - min(f1) OVER w) / (max(f1) OVER w - min(f1) OVER w) + 0.5 * (max(latency) OVER w - latency) / (max(latency) OVER w - min(latency) OVER w) AS score FROM {_TRIALS} WINDOW w AS (PARTITION BY dataset_id))
SELECT dataset_id, arg_max(number, (round(score, 9), number)) AS number, round(max(score), 6) AS tradeoff FROM t GROUP BY 1""")
def tradeoff_best(spark: SparkSession, d: str) -> DataFrame:
    """The best compromise of each table."""
    t = V.tradeoff(_trials(spark, d), "latency", "f1", "dataset_id")
    return t.groupBy("dataset_id").agg(F.max_by("number", F.struct(F.round("tradeoff", 9), F.col("number"))).alias("number"), F.round(F.max("tradeoff"), 6).alias("tradeoff"))


@R.add(f"SELECT dataset_id, min(latency) AS min_latency, max(latency) AS max_latency, round(avg(latency), 4) AS mean_latency, round(stddev_samp(latency), 4) AS std_latency, round(min(f1), 6) AS min_f1, round(max(f1), 6) AS max_f1, round(avg(f1), 6) AS mean_f1, round(stddev_samp(f1), 6) AS std_f1 FROM {_TRIALS} GROUP BY 1")
def trial_stats(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of each table's trials, numbers written with a decimal comma."""
    t = _trials(spark, d).withColumn("latency", S.comma_decimal(F.replace(F.col("latency").cast("string"), F.lit("."), F.lit(","))))
    s = V.trial_stats(t, ["latency", "f1"], "dataset_id")
    return s.select("dataset_id", "min_latency", "max_latency", *[F.round(c, 4).alias(c) for c in ("mean_latency", "std_latency")], *[F.round(c, 6).alias(c) for c in ("min_f1", "max_f1", "mean_f1", "std_f1")])


_STAGES = "(SELECT o_orderpriority AS dataset_id, o_orderstatus AS stage, avg(o_totalprice) AS seconds, CAST(count(*) AS DOUBLE) AS n_rows FROM orders GROUP BY ALL)"


@R.add(f"SELECT a.dataset_id, a.stage, round(a.seconds, 4) AS seconds, a.n_rows, round(a.seconds - b.seconds, 4) AS delta_seconds, round((a.seconds - b.seconds) / b.seconds * 100, 4) AS percent_seconds, a.n_rows - b.n_rows AS delta_n_rows, round((a.n_rows - b.n_rows) / b.n_rows * 100, 4) AS percent_n_rows FROM {_STAGES} a LEFT JOIN {_STAGES} b ON a.dataset_id = b.dataset_id AND b.stage = 'F'")
def stage_summary(spark: SparkSession, d: str) -> DataFrame:
    """Stages of every table against its baseline."""
    s = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("dataset_id"), F.col("o_orderstatus").alias("stage")).agg(F.avg("o_totalprice").alias("seconds"), F.count("*").cast("double").alias("n_rows"))
    v = V.stage_summary(s, "stage", ["seconds", "n_rows"], "F", "dataset_id")
    return v.select("dataset_id", "stage", "n_rows", "delta_n_rows", *[F.round(c, 4).alias(c) for c in ("seconds", "delta_seconds", "percent_seconds", "percent_n_rows")])


# --- composite difficulty: nations as tables -----------------------------------------------------------

_METRICS = "SELECT n_name AS dataset_id, avg(o_totalprice) AS anova_f_mean, stddev_pop(o_totalprice) AS mutual_info_mean, CAST(count(*) AS DOUBLE) AS pca_centroid_distance_pca_centroid_score, max(o_totalprice) AS mahalanobis_class_distance_mean, min(o_totalprice) AS svm_margin_mean, CAST(count(DISTINCT o_orderpriority) AS DOUBLE) AS class_proba_entropy_mean, CAST(count(DISTINCT c_custkey) AS DOUBLE) AS intrinsic_dimensionality_intrinsic_dimensionality_percent, max(o_totalprice) - min(o_totalprice) AS calinski_harabasz_calinski_harabasz_score, avg(c_acctbal) AS class_confusion_entropy_confusion_entropy, CASE WHEN n_name < 'C' THEN NULL ELSE avg(o_orderkey % 7) END AS class_imbalance_normalized_entropy FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "orders").join(table(spark, d, "customer"), F.expr("o_custkey = c_custkey")).join(table(spark, d, "nation"), F.expr("c_nationkey = n_nationkey"))
    p = F.col("o_totalprice")
    return x.groupBy(F.col("n_name").alias("dataset_id")).agg(
        F.avg(p).alias("anova_f_mean"), F.stddev_pop(p).alias("mutual_info_mean"), F.count("*").cast("double").alias("pca_centroid_distance_pca_centroid_score"), F.max(p).alias("mahalanobis_class_distance_mean"), F.min(p).alias("svm_margin_mean"),
        F.count_distinct("o_orderpriority").cast("double").alias("class_proba_entropy_mean"), F.count_distinct("c_custkey").cast("double").alias("intrinsic_dimensionality_intrinsic_dimensionality_percent"), (F.max(p) - F.min(p)).alias("calinski_harabasz_calinski_harabasz_score"),
        F.avg("c_acctbal").alias("class_confusion_entropy_confusion_entropy"), F.avg(F.col("o_orderkey") % 7).alias("class_imbalance_normalized_entropy"),
    ).withColumn("class_imbalance_normalized_entropy", F.when(F.col("dataset_id") >= "C", F.col("class_imbalance_normalized_entropy")))


_ALL = [c for g in D.GROUPS.values() for c in g]
_SCALED = ", ".join(f"CASE WHEN max({c}) OVER () > min({c}) OVER () THEN ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) ELSE 0 END AS {c}" for c in _ALL)
_TURNED = ", ".join(f"coalesce({'-' if c in D.INVERTED else ''}{c}, 0) AS {c}" for c in _ALL)
_GROUPED = ", ".join(f"({' + '.join(cs)}) / {len(cs)} AS difficulty_{g}" for g, cs in D.GROUPS.items())


@R.add(f"WITH m AS ({_METRICS}), t AS (SELECT dataset_id, {_TURNED} FROM m WHERE dataset_id NOT LIKE '%UNITED%'), s AS (SELECT dataset_id, {_SCALED} FROM t), g AS (SELECT dataset_id, {_GROUPED} FROM s) SELECT dataset_id, {', '.join(f'round(difficulty_{g}, 6) AS difficulty_{g}' for g in D.GROUPS)}, round(({' + '.join(f'difficulty_{g}' for g in D.GROUPS)}) / 5, 6) AS difficulty FROM g")
def composite_difficulty(spark: SparkSession, d: str) -> DataFrame:
    """Difficulty of every nation's orders, by group and overall."""
    c = D.composite(_metrics(spark, d), exclude=("UNITED",))
    return c.select("dataset_id", *[F.round(x, 6).alias(x) for x in c.columns[1:]])


@R.add(f"WITH m AS ({_METRICS}) SELECT dataset_id, 10 - CAST(class_imbalance_normalized_entropy IS NULL AS INT) AS n_metrics, 5 AS n_groups, true AS usable FROM m")
def metric_availability(spark: SparkSession, d: str) -> DataFrame:
    """How many metrics and groups each table has."""
    return D.available(_metrics(spark, d)).select("dataset_id", "n_metrics", "n_groups", "usable")


@R.add("SELECT o_orderpriority AS dataset_id, unnest(['price_max', 'price_mean', 'keys_n']) AS name, round(unnest([max(o_totalprice), avg(o_totalprice), CAST(count(*) AS DOUBLE)]), 4) AS value FROM orders GROUP BY 1")
def flatten_metrics(spark: SparkSession, d: str) -> DataFrame:
    """A map of maps as named values."""
    x = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("dataset_id")).agg(F.max("o_totalprice").alias("m"), F.avg("o_totalprice").alias("a"), F.count("*").cast("double").alias("n"))
    maps = F.create_map(F.lit("price"), F.create_map(F.lit("max"), "m", F.lit("mean"), "a"), F.lit("keys"), F.create_map(F.lit("n"), "n"))
    return D.flattened(x.select("dataset_id", maps.alias("metrics")), "metrics", "dataset_id").select("dataset_id", "name", F.round("value", 4).alias("value"))


# --- analysis ------------------------------------------------------------------------------------------

_BYSEG = "(SELECT c_mktsegment AS approach, c_nationkey AS k, round(avg(c_acctbal), 0) AS difficulty, CAST(count(*) AS DOUBLE) AS f1, round(max(c_acctbal), 0) AS seconds FROM customer GROUP BY ALL)"


@R.add(f"""WITH l AS (SELECT approach, difficulty AS x, unnest(['f1', 'seconds']) AS metric, unnest([f1, seconds]) AS y FROM {_BYSEG}),
r AS (SELECT *, rank() OVER (PARTITION BY approach, metric ORDER BY x) + (count(*) OVER (PARTITION BY approach, metric, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY approach, metric ORDER BY y) + (count(*) OVER (PARTITION BY approach, metric, y) - 1) / 2 AS ry FROM l),
c AS (SELECT approach, metric, corr(x, y) AS p, corr(rx, ry) AS s FROM r GROUP BY ALL),
k AS (SELECT a.approach, a.metric, sum(sign(a.x - b.x) * sign(a.y - b.y)) / sqrt(CAST(sum(abs(sign(a.x - b.x))) AS DOUBLE) * sum(abs(sign(a.y - b.y)))) AS tau FROM l a JOIN l b ON a.approach = b.approach AND a.metric = b.metric GROUP BY ALL)
SELECT approach, metric, round(p, 6) AS pearson, round(s, 6) AS spearman, round(tau, 6) AS kendall FROM c JOIN k USING (approach, metric)""")
def correlation_table(spark: SparkSession, d: str) -> DataFrame:
    """Three correlations of scores with difficulty, per approach."""
    x = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("approach"), "c_nationkey").agg(F.round(F.avg("c_acctbal"), 0).alias("difficulty"), F.count("*").cast("double").alias("f1"), F.round(F.max("c_acctbal"), 0).alias("seconds"))
    c = N.correlation_table(x, ["f1", "seconds"], "difficulty", "approach")
    return c.select("approach", "metric", *[F.round(m, 6).alias(m) for m in ("pearson", "spearman", "kendall")])


def _kde_sql(value: str, where: str = "") -> str:
    return f"""WITH v AS (SELECT {value} AS x FROM supplier {where}), r AS (SELECT min(x) AS lo, max(x) AS hi, stddev_samp(x) * power(count(*), -0.2) AS h, count(*) AS n FROM v), g AS (SELECT unnest(range(0, 100)) AS i)
SELECT CAST(i AS INTEGER) AS i, round(lo + i * (hi - lo) / 99, 6) AS at, round(sum(exp(-0.5 * power((lo + i * (hi - lo) / 99 - x) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())) * 1e3, 6) AS density FROM v, r, g GROUP BY i, lo, hi"""


def _curve(x: DataFrame) -> DataFrame:
    return N.kde(x, "x", N.grid(x, "x", 100)).select("i", F.round("at", 6).alias("at"), F.round(F.col("density") * 1e3, 6).alias("density"))


@R.add(_kde_sql("s_acctbal"))
def kde_curve(spark: SparkSession, d: str) -> DataFrame:
    """Density of supplier balances (times 1000)."""
    return _curve(table(spark, d, "supplier").select(F.col("s_acctbal").alias("x")))


@R.add(_kde_sql("log10(s_acctbal)", "WHERE s_acctbal > 0"))
def kde_curve_log(spark: SparkSession, d: str) -> DataFrame:
    """Density of their decimal logarithm."""
    return _curve(table(spark, d, "supplier").select(S.log10_or_null(F.col("s_acctbal")).alias("x")).where("x is not null"))


_BOOT = """b AS (SELECT s_suppkey, s_acctbal AS x, row_number() OVER (ORDER BY md5(concat(CAST(s_suppkey AS VARCHAR), '#42')), s_suppkey) AS rank, count(*) OVER () AS size FROM supplier {w}),
dr AS (SELECT replicate, CAST(floor(CAST(concat('0x', substr(md5(concat(CAST(replicate AS VARCHAR), '|', CAST(rank AS VARCHAR), '#42')), 1, 8)) AS BIGINT) / 4294967296.0 * size) + 1 AS BIGINT) AS rank FROM b, (SELECT unnest(range(1, 21)) AS replicate)),
v AS (SELECT replicate, x FROM dr JOIN b USING (rank)), h AS (SELECT replicate, stddev_samp(x) * power(count(*), -0.2) AS h, count(*) AS n FROM v GROUP BY 1),
r AS (SELECT min(s_acctbal) AS lo, max(s_acctbal) AS hi FROM supplier), g AS (SELECT i, lo + i * (hi - lo) / 19 AS pos FROM r, (SELECT unnest(range(0, 20)) AS i)),
k AS (SELECT i, pos, replicate, sum(exp(-0.5 * power((pos - x) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())) * 1e3 AS density FROM v JOIN h USING (replicate), g GROUP BY ALL)"""


@R.add(f"WITH {_BOOT.format(w='')} SELECT CAST(i AS INTEGER) AS i, round(quantile_cont(density, 0.025), 6) AS lower, round(quantile_cont(density, 0.975), 6) AS upper FROM k GROUP BY i")
def kde_band(spark: SparkSession, d: str) -> DataFrame:
    """Bootstrap band of the density (20 replicates, 20 points)."""
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("x"))
    return N.kde_band(s, "x", "s_suppkey", N.grid(s, "x", 20), 20).select("i", F.round(F.col("lower") * 1e3, 6).alias("lower"), F.round(F.col("upper") * 1e3, 6).alias("upper"))


@R.add(f"""SELECT a.i, round(a.lower - b.upper, 5) AS low, round(a.upper - b.lower, 5) AS high FROM
(WITH {_BOOT.format(w='WHERE s_nationkey < 12')} SELECT CAST(i AS INTEGER) AS i, quantile_cont(density, 0.025) AS lower, quantile_cont(density, 0.975) AS upper FROM k GROUP BY i) a JOIN
(WITH {_BOOT.format(w='WHERE s_nationkey >= 12')} SELECT CAST(i AS INTEGER) AS i, quantile_cont(density, 0.025) AS lower, quantile_cont(density, 0.975) AS upper FROM k GROUP BY i) b USING (i)""")
def kde_difference(spark: SparkSession, d: str) -> DataFrame:
    """Conservative band of the difference of two densities."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", F.col("s_acctbal").alias("x"))
    points = N.grid(s, "x", 20)
    a, b = (N.kde_band(s.where(w), "x", "s_suppkey", points, 20) for w in ("s_nationkey < 12", "s_nationkey >= 12"))
    return N.kde_difference(a, b).select("i", F.round(F.col("low") * 1e3, 5).alias("low"), F.round(F.col("high") * 1e3, 5).alias("high"))


@R.add("""WITH m AS (SELECT o_orderpriority, avg(o_totalprice) AS mu FROM orders GROUP BY 1), c AS (SELECT o_orderpriority, count(*) AS n, avg(power(o_totalprice - mu, 2)) AS m2, avg(power(o_totalprice - mu, 3)) AS m3, avg(power(o_totalprice - mu, 4)) AS m4 FROM orders JOIN m USING (o_orderpriority) GROUP BY 1),
s AS (SELECT o_orderpriority, n, m3 / power(m2, 1.5) AS skew, m4 / (m2 * m2) - 3 AS kurt FROM c)
SELECT o_orderpriority, n, round(skew, 6) AS skewness, round(kurt, 6) AS kurtosis, n / 6 * (skew * skew + kurt * kurt / 4) < 5.991 AS normal FROM s""")
def normality_flag(spark: SparkSession, d: str) -> DataFrame:
    """Whether prices look normal, by priority."""
    f = N.normality_flag(table(spark, d, "orders"), "o_totalprice", "o_orderpriority")
    return f.select("o_orderpriority", "n", F.round("skewness", 6).alias("skewness"), F.round("kurtosis", 6).alias("kurtosis"), "normal")


@R.add(f"SELECT dataset_id, arg_max(number, (f1, -latency)) AS best_f1, arg_min(number, (latency, -f1)) AS best_latency, round(max(f1), 6) AS f1 FROM {_TRIALS} GROUP BY 1")
def best_configuration(spark: SparkSession, d: str) -> DataFrame:
    """The best trial of each table by score, and by cost."""
    return _trials(spark, d).groupBy("dataset_id").agg(F.max_by("number", F.struct("f1", -F.col("latency"))).alias("best_f1"), F.min_by("number", F.struct("latency", -F.col("f1"))).alias("best_latency"), F.round(F.max("f1"), 6).alias("f1"))
