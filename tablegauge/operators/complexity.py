"""How hard a labelled table is: relevance, overlap, hardness, structure and imbalance."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stored import discarded, stored
from .metric_neighbours import nearest
from .moments import class_counts, imbalance, summary
from .neighbour_passes import nearest_enemies, neighbour_labels

#: Rows up to which ``neighbours`` offers exact neighbours by one broadcast.
EXACT_ROWS = 5000


def anova_f(moments: DataFrame, *by: str) -> DataFrame:
    """``by, feature, f`` from class moments; classes of one row add nothing but are counted; 0 where undefined."""
    w = Window.partitionBy(*by, "feature")
    grand = F.sum(F.col("n") * F.col("mean")).over(w) / F.sum("n").over(w)
    rows = moments.withColumn("grand", grand).groupBy(*by, "feature").agg(
        F.count("*").alias("k"), F.sum("n").alias("n"),
        F.sum(F.when(F.col("n") > 1, F.col("n") * (F.col("mean") - F.col("grand")) ** 2).otherwise(0.0)).alias("ssb"),
        F.sum(F.when(F.col("n") > 1, F.col("m2")).otherwise(0.0)).alias("ssw"),
    )
    ok = (F.col("ssw") > 0) & (F.col("k") > 1) & (F.col("n") > F.col("k"))
    f = (F.col("ssb") / (F.col("k") - 1)) / (F.col("ssw") / (F.col("n") - F.col("k")))
    return rows.select(*by, "feature", F.when(ok, f).otherwise(0.0).alias("f"))


def calinski_harabasz(moments: DataFrame, *by: str) -> DataFrame:
    """Between- over within-class scatter, all features together."""
    w = Window.partitionBy(*by, "feature")
    grand = F.sum(F.col("n") * F.col("mean")).over(w) / F.sum("n").over(w)
    s = moments.withColumn("grand", grand).groupBy(*by).agg(
        F.sum(F.col("n") * (F.col("mean") - F.col("grand")) ** 2).alias("ssb"), F.sum("m2").alias("ssw"),
        F.count_distinct("label").alias("k"), (F.sum("n") / F.count_distinct("feature")).alias("n"),
    )
    ok = (F.col("ssw") > 0) & (F.col("k") > 1) & (F.col("n") > F.col("k"))
    return s.select(*by, F.when(ok, (F.col("ssb") / (F.col("k") - 1)) / (F.col("ssw") / (F.col("n") - F.col("k")))).otherwise(0.0).alias("calinski_harabasz"))


def centroid_distance(moments: DataFrame, *by: str) -> DataFrame:
    """Mean Euclidean distance of class centroids, each pair once (K rows a feature)."""
    a = moments.select(*by, "feature", F.col("label").alias("la"), F.col("mean").alias("ma"))
    b = moments.select(*by, "feature", F.col("label").alias("lb"), F.col("mean").alias("mb"))
    pairs = a.join(b, [*by, "feature"]).where("la < lb").groupBy(*by, "la", "lb").agg(F.sqrt(F.sum((F.col("ma") - F.col("mb")) ** 2)).alias("distance"))
    return pairs.groupBy(*by).agg(F.avg("distance").alias("centroid_distance"))


def bins_for(n: int) -> int:
    """Bins of a mutual-information histogram."""
    return min(64, max(10, int(math.sqrt(n))))


def mutual_information(histogram: DataFrame) -> DataFrame:
    """``feature, mutual_information`` (nats) from joint counts ``feature, bin, label, n``."""
    p = F.col("n") / F.sum("n").over(Window.partitionBy("feature"))
    x = F.sum("n").over(Window.partitionBy("feature", "bin")) / F.sum("n").over(Window.partitionBy("feature"))
    y = F.sum("n").over(Window.partitionBy("feature", "label")) / F.sum("n").over(Window.partitionBy("feature"))
    return histogram.select("feature", (p * F.log(p / (x * y))).alias("part")).groupBy("feature").agg(F.sum("part").alias("mutual_information"))


def class_imbalance(df: DataFrame, label: str, *by: str) -> DataFrame:
    """Classes, count ratio and normalised entropy."""
    return imbalance(class_counts(df, label, *by), *by)


def neighbours(df: DataFrame, key: str, label: str, vector: str, k: int, include_self: bool = False, most_rows: int = EXACT_ROWS) -> DataFrame:
    """``key, label, other, other_label, distance, rank``: each row's ``k`` nearest, by distance and key.

    Exact, and refused beyond ``most_rows``: every row meets every other there, in a
    broadcast whose size that bound fixes. ``nearest`` serves tables of any size.
    """
    n = df.count()
    if n > most_rows:
        raise ValueError(f"{n} rows: use approximate_neighbours")
    a = df.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).alias("v"))
    b = df.select(F.col(key).alias("other"), F.col(label).alias("other_label"), F.col(vector).alias("u"))
    square = F.aggregate(F.zip_with("v", "u", lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    met = a.join(F.broadcast(b), F.lit(True) if include_self else F.col("key") != F.col("other")).withColumn("distance", F.sqrt(square))
    near = met.groupBy("key", "label").agg(F.slice(F.sort_array(F.collect_list(F.struct("distance", "other", "other_label"))), 1, k).alias("near"))
    return near.select("key", "label", F.posexplode("near").alias("rank", "x")).select("key", "label", "x.other", "x.other_label", "x.distance", (F.col("rank") + 1).alias("rank"))


def approximate_neighbours(df: DataFrame, key: str, label: str, vector: str, k: int, bucket: float, tables: int = 8, reach: float = float("inf"), include_self: bool = False) -> DataFrame:
    """The same from locality-sensitive buckets, for tables of any size."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    rows = df.select(F.col(key).alias("key"), F.col(label).alias("label"), array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=bucket, numHashTables=tables, seed=42).fit(rows)
    met = model.approxSimilarityJoin(rows, rows, reach, "distance")
    if not include_self:
        met = met.where("datasetA.key <> datasetB.key")
    order = Window.partitionBy("key").orderBy("distance", "other")
    flat = met.select("datasetA.key", "datasetA.label", F.col("datasetB.key").alias("other"), F.col("datasetB.label").alias("other_label"), "distance")
    return flat.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def neighbour_count(n: int) -> int:
    """Neighbours for a table of ``n`` rows."""
    return max(2, int(math.sqrt(n)))


def kdn(near: DataFrame) -> DataFrame:
    """``key, kdn``: share of a row's neighbours with another label."""
    return near.groupBy("key").agg(F.avg((F.col("label") != F.col("other_label")).cast("int")).alias("kdn"))


def nearest_enemy(df: DataFrame, key: str, label: str, vector: str) -> DataFrame:
    """``key, distance`` to the nearest of all rows of another label; rows without one are left out."""
    return nearest_enemies(df, key, label, vector)


def knn_overlap(df: DataFrame, key: str, label: str, vector: str, k: int) -> DataFrame:
    """One minus the accuracy of the majority vote of ``k`` neighbours, the row itself being one (ties to the lesser label)."""
    votes = neighbour_labels(df, key, label, vector, k)
    vote = votes.groupBy("key", "label").agg(F.max_by("other_label", F.struct("n", -F.col("other_label"))).alias("vote"))
    return vote.agg((1 - F.avg((F.col("vote") == F.col("label")).cast("int"))).alias("knn_overlap"))


def silhouette(df: DataFrame, label: str, vector: str) -> DataFrame:
    """Mean silhouette by squared Euclidean distance, in one pass over rows and class sums."""
    rows = df.select(F.col(label).alias("label"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    rows = rows.withColumn("q", F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    sums = rows.select("label", "q", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("s"), F.count("*").alias("n"), F.sum("q").alias("q"))
    classes = sums.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "s"))), lambda t: t["s"]).alias("s"), F.first("n").alias("n"), F.first("q").alias("q"))
    known = F.broadcast(classes.select(F.col("label").alias("c"), "s", "n", F.col("q").alias("cq")))  # one row a class
    dot = F.aggregate(F.zip_with("v", "s", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    total = F.col("n") * F.col("q") + F.col("cq") - 2 * dot  # sum of squared distances to the class
    own = F.when(F.col("label") == F.col("c"), F.when(F.col("n") > 1, total / (F.col("n") - 1)))
    other = F.when(F.col("label") != F.col("c"), total / F.col("n"))
    each = rows.withColumn("row", F.monotonically_increasing_id()).crossJoin(known).groupBy("row").agg(F.max(own).alias("a"), F.min(other).alias("b"))
    return each.agg(F.avg(F.when(F.col("a").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))).alias("silhouette"))


def mahalanobis(df: DataFrame, label: str, features: list[str]) -> DataFrame:
    """Ten statistics of each row's Mahalanobis distance to its class mean.

    Covariances (K matrices of P by P) are inverted on the driver with 1e-6 added to the
    diagonal; rows are scored batch by batch. Rows with a null feature have no distance.
    """
    import numpy as np

    from . import gram

    p = len(features)
    means = gram.class_means(df, label, features)
    cov = {k: np.zeros((p, p)) for k in means}
    for r in gram.covariances(df, label, features, means).collect():  # K x P x P numbers
        cov[r["label"]][r["a"], r["b"]] = cov[r["label"]][r["b"], r["a"]] = r["covariance"] or 0.0
    inverse = {k: np.linalg.inv(c + 1e-6 * np.eye(p)) for k, c in cov.items()}
    return summary(stored(gram.quadratic(df, label, features, means, inverse).select("x"), "distances"), "x")  # which its statistics read several times


def _vectors(df: DataFrame, label: str, features: list[str]) -> DataFrame:
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    # names of its own, as the table may have columns called y or features
    inputs = [f"__f{i}" for i in range(len(features))]
    own = df.select(F.col(label).alias("__label"), *[F.col(c).cast("double").alias(n) for c, n in zip(features, inputs, strict=True)])
    rows = VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="skip").transform(own)
    return StringIndexer(inputCol="__label", outputCol="y", stringOrderType="alphabetAsc").fit(rows).transform(rows).select("features", "y")


def svm_margin(df: DataFrame, label: str, features: list[str], signed: bool = False) -> DataFrame:
    """Ten statistics of the rows' margin under linear support-vector machines (C = 1)."""
    from pyspark.ml.functions import vector_to_array

    from . import linear_svm

    rows = _vectors(df, label, features).select("y", vector_to_array("features").alias("x"))
    blocks = stored(linear_svm.packed(rows), "svm-blocks")
    margins = stored(linear_svm.decided(blocks, linear_svm.fitted(blocks), signed), "svm-margins")  # which its statistics read several times
    discarded(blocks)
    return summary(margins, "x")


def _logistic(df: DataFrame, label: str, features: list[str]):
    """The rows as vectors, and a logistic regression of them."""
    from pyspark.ml.classification import LogisticRegression

    rows = _vectors(df, label, features)
    return rows, LogisticRegression(labelCol="y", regParam=1.0 / max(1, rows.count()), maxIter=50).fit(rows)


def probability_entropy(df: DataFrame, label: str, features: list[str], fitted: tuple | None = None) -> DataFrame:
    """Ten statistics of the entropy of logistic-regression probabilities (C = 1); ``fitted`` is what ``_logistic`` gave."""
    from pyspark.ml.functions import vector_to_array

    from ..functions.scalars import entropy

    rows, model = fitted or _logistic(df, label, features)
    return summary(stored(model.transform(rows).select(entropy(vector_to_array("probability")).alias("x")), "entropies"), "x")


def intrinsic_dimension(df: DataFrame, features: list[str], share: float = 0.95) -> tuple[int, float]:
    """Components whose variance reaches the share (1 if never), and their percent of features."""
    from pyspark.ml.feature import PCA, VectorAssembler

    rows = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(df)
    explained = PCA(k=len(features), inputCol="features", outputCol="pc").fit(rows).explainedVariance.toArray()
    total, k = 0.0, 1
    for i, v in enumerate(explained):
        total += float(v)
        if total >= share:
            k = i + 1
            break
    return k, 100.0 * k / len(features)


def confusion_entropy(confusion: DataFrame) -> DataFrame:
    """Mean over true classes of the entropy of their predictions, from counts ``y, yhat, n``."""
    p = F.col("n") / F.sum("n").over(Window.partitionBy("y"))
    return confusion.select("y", (-p * F.log(p + 1e-10)).alias("h")).groupBy("y").agg(F.sum("h").alias("h")).agg(F.avg("h").alias("confusion_entropy"))


def validated(metrics: DataFrame, expected: DataFrame) -> DataFrame:
    """``metric, sub_metric, value, status``: ok, missing, or not a number."""
    joined = expected.join(metrics, ["metric", "sub_metric"], "left")
    status = F.when(F.col("value").isNull(), "missing").when(F.isnan("value"), "nan").otherwise("ok")
    return joined.select("metric", "sub_metric", "value", status.alias("status"))


def metric_record(df: DataFrame, label: str, features: list[str]) -> DataFrame:
    """``metric, sub_metric, value``: the measures that class moments give, which are computed and stored once."""
    from .moments import class_moments

    m = stored(class_moments(df, label, features), "moments")
    # a class's rows; the features' counts lack its nulls
    counts = m.groupBy("label").agg(F.max("n").alias("n"))
    stack = "stack(3, 'n_classes', cast(n_classes as double), 'imbalance_ratio', imbalance_ratio, 'normalized_entropy', normalized_entropy) as (sub_metric, value)"
    return (
        anova_f(m).select(F.lit("anova_f").alias("metric"), F.col("feature").alias("sub_metric"), F.col("f").alias("value"))
        .unionByName(calinski_harabasz(m).select(F.lit("calinski_harabasz").alias("metric"), F.lit("score").alias("sub_metric"), F.col("calinski_harabasz").alias("value")))
        .unionByName(centroid_distance(m).select(F.lit("centroid_distance").alias("metric"), F.lit("mean").alias("sub_metric"), F.col("centroid_distance").alias("value")))
        .unionByName(imbalance(counts).selectExpr("'class_imbalance' as metric", stack))
    )


#: Statistics that a metric over rows is reported by.
STATISTICS = ("size", "max", "min", "mean", "median", "q1", "q3", "iqr", "std", "variance")


#: The ten metrics of a table, two a group.
METRICS = ("anova_f", "mutual_information", "centroid_distance", "mahalanobis", "svm_margin", "probability_entropy", "intrinsic_dimension", "calinski_harabasz", "class_confusion_entropy", "class_imbalance")


def model_confusion_entropy(df: DataFrame, label: str, features: list[str], fitted: tuple | None = None) -> DataFrame:
    """``confusion_entropy`` of a logistic regression (C = 1) on the rows it has learnt from; ``fitted`` as above."""
    rows, model = fitted or _logistic(df, label, features)
    counts = model.transform(rows).groupBy("y", F.col("prediction").alias("yhat")).agg(F.count("*").alias("n"))
    return confusion_entropy(counts)


def metric_jobs(df: DataFrame, label: str, features: list[str], key: str | None = None) -> dict[str, Callable[[], DataFrame]]:
    """For each of the ten metrics, what computes its ``sub_metric, value``; ``key`` allows that of neighbours, an eleventh."""
    from .moments import class_moments, histogram

    def statistics(frame: DataFrame) -> DataFrame:
        return frame.select(F.explode(F.array(*[F.struct(F.lit(s).alias("sub_metric"), F.col(s).cast("double").alias("value")) for s in STATISTICS])).alias("x")).select("x.*")

    record = functools.cache(lambda: stored(metric_record(df, label, features), "record"))  # four metrics share it

    logistic = functools.cache(lambda: _logistic(df, label, features))  # two share it

    def of_moments(metric: str) -> Callable[[], DataFrame]:
        return lambda: record().where(F.col("metric") == metric).select("sub_metric", "value")

    def information() -> DataFrame:
        h = histogram(df, label, features, bins_for(df.count()))
        return mutual_information(h).select(F.col("feature").alias("sub_metric"), F.col("mutual_information").alias("value"))

    def dimension() -> DataFrame:
        k, percent = intrinsic_dimension(df, features)
        return df.sparkSession.createDataFrame([("components", float(k)), ("percent", float(percent))], "sub_metric string, value double")

    def neighbourhood() -> DataFrame:
        rows = df.select(F.col(key).alias("key"), F.col(label).alias("label"), F.array(*[F.col(c).cast("double") for c in features]).alias("v"))
        each = kdn(nearest(rows, "key", "label", "v", neighbour_count(rows.count())))
        return each.agg(F.avg("kdn").alias("value")).select(F.lit("mean").alias("sub_metric"), "value")

    jobs = {m: of_moments(m) for m in ("anova_f", "calinski_harabasz", "centroid_distance", "class_imbalance")}
    jobs |= {
        "mutual_information": information,
        "mahalanobis": lambda: statistics(mahalanobis(df, label, features)),
        "svm_margin": lambda: statistics(svm_margin(df, label, features)),
        "probability_entropy": lambda: statistics(probability_entropy(df, label, features, logistic())),
        "intrinsic_dimension": dimension,
        "class_confusion_entropy": lambda: model_confusion_entropy(df, label, features, logistic()).select(F.lit("confusion_entropy").alias("sub_metric"), F.col("confusion_entropy").alias("value")),
    }
    return jobs | ({"kdn": neighbourhood} if key else {})


def measured(df: DataFrame, label: str, features: list[str], key: str | None = None, metrics: list[str] | None = None) -> DataFrame:
    """``metric, sub_metric, value, status, message``: each of ``METRICS``, or those named, on its own, so that one that fails is a row.

    ``status`` is ok, nan, or error with a null value and the message. What is collected is
    the few numbers of each metric. A metric of an unknown name is an error too.
    """
    jobs = metric_jobs(df, label, features, key)
    out: list[tuple] = []
    for name in metrics if metrics is not None else METRICS:
        try:
            got = [(r["sub_metric"], r["value"]) for r in jobs[name]().collect()]
            out += [(name, s, v, "nan" if v is None or math.isnan(v) else "ok", None) for s, v in got]
            if not got:
                out.append((name, None, None, "error", "no value"))
        except Exception as e:  # noqa: BLE001  a failed metric is a record
            out.append((name, None, None, "error", f"{type(e).__name__}: {e}"[:200]))
    return df.sparkSession.createDataFrame(out, "metric string, sub_metric string, value double, status string, message string")
