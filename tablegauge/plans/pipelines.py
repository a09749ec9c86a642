"""Whole pipelines: cleaning, complexity over sample fractions, and file round trips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import port_service
from ..functions.stored import shared_path, stored
from ..operators import clean as C
from ..operators import complexity as X
from ..operators import encode as E
from ..operators import profile as P
from ..operators import sample as A
from ..sources import readers as I


def cleaned(
    df: DataFrame, target: str, numbers: str = "shrink", text: str = "plan", digits: int | None = 3, ports: bool = True, bins: int | None = None, least_variance: float | None = None
) -> DataFrame:
    """Fills, numeric texts, address and identifier columns, ports, encodings, filters, narrow types and names.

    Profiles decide, one pass each; projections apply what they decide. ``numbers``: keep, shrink or
    narrowest; ``text``: keep, drop, encode (codes or hash buckets), or plan (by cardinality and skew);
    ``digits``: decimals left, or None; ``ports``: port-like columns become services; ``bins``: fractional
    columns become so many quantile bins; ``least_variance``: numbers below it go.
    """
    if numbers not in ("keep", "shrink", "narrowest") or text not in ("keep", "drop", "encode", "plan"):
        raise ValueError(f"no mode {numbers!r} for numbers or {text!r} for text")
    df = P.numeric_text(df.na.fill(0).na.fill("0"))
    address = P.pattern_shares(df.drop(target), lambda c: P.is_ip(c) | P.is_mac(c), 0.95)
    named = address.select("column").unionByName(P.identifier_columns(df, target).select("column")).unionByName(P.near_unique(df).select("column"))
    df = df.drop(*[r["column"] for r in named.collect() if r["column"] != target])  # a row per column
    if least_variance is not None:
        df = df.drop(*[r["column"] for r in P.low_variance(df, target, least_variance).collect()])  # a row per column
    if ports and any(w in c.lower() and not any(x in c.lower() for x in P.NO_PORT_NAMES) for c in C.columns_of(df.drop(target), "number") for w in P.PORT_NAMES):
        found = [r["column"] for r in P.port_like(df.drop(target)).collect()]  # a row per column
        df = df.withColumns({c: port_service(F.col(c)) for c in found})
    names = [c for c in C.columns_of(df, "text") if c != target] if text == "plan" else []
    plan = {r["column"]: r["action"] for r in E.cardinality_plan(df.select(*names)).collect()} if names else {}
    if text in ("drop", "encode"):
        df = E.text_columns(df, text, but=(target,))
    for c, action in plan.items():
        if action in ("frequency", "count"):
            df = E.frequency_encode(df, c, "__e", share=action == "frequency").drop(c).withColumnRenamed("__e", c)
        elif action == "hash":
            df = df.withColumn(c, E.hash_encode(F.col(c), 1 << 16))
    df = C.drop_infinite(df).na.drop("any").dropDuplicates()
    floats = [c for c in C.columns_of(df, "float") if c != target]
    if digits is not None:
        df = df.withColumns({c: F.bround(c, digits) for c in floats})
    for c in floats if bins else []:
        df = E.quantile_bins(df, c, "__b", bins).drop(c).withColumnRenamed("__b", c)
    return C.normalized_columns(df if numbers == "keep" else P.shrink(df, numbers == "narrowest"), target)


def complexity(df: DataFrame, label: str, features: list[str], key: str, fractions: list[float], metrics: list[str] | None = None) -> DataFrame:
    """``fraction, metric, sub_metric, value, status, message`` for nested sample fractions of a table.

    All ten metrics, or those named; one that fails is a row of its own.
    """
    df, out = stored(df.select(key, label, *features), "table"), None
    for f in fractions:
        part = A.fraction_sample(df, key, f) if f < 1 else df
        row = X.measured(part, label, features, key, metrics).select(F.lit(f).alias("fraction"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def csv_roundtrip(df: DataFrame) -> DataFrame:
    """A table as delimited text and back, all text, with header repeats inside removed."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, "delimited")
    text = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    repeats = spark.range(3).select(*[F.lit(c).alias(c) for c in df.columns])
    text.unionByName(repeats).write.option("header", True).csv(path)
    return I.without_repeated_headers(I.csv_with_header(spark, path), df.columns[0])


def file_labels(df: DataFrame, label: str) -> DataFrame:
    """Rows written to a folder per label and labelled again by their path."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, "labelled")
    df.withColumn("part", F.col(label)).drop(label).write.partitionBy("part").option("header", True).csv(path)
    names = [c for c in df.columns if c != label]
    read = spark.read.option("header", True).option("recursiveFileLookup", True).csv(path)
    return read.select(*names, I.label_from_path(r"part=([^/]+)/").alias(label))


def log_scan(df: DataFrame) -> DataFrame:
    """A tab-separated log with comment lines, read back by fixed names."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, "log")
    lines = df.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in df.columns]).alias("value"))
    spark.range(2).select(F.concat(F.lit("#comment "), F.col("id").cast("string")).alias("value")).unionByName(lines).write.text(path)
    return I.csv_named(spark, path, df.columns, "\t", "#")


def json_metrics(df: DataFrame) -> DataFrame:
    """Results of each table as a JSON file, scanned back into rows."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, "results")
    per = df.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean"))
    record = F.to_json(F.struct(F.struct("n", "mean").alias("price"), F.array(F.lit("none")).alias("errors")))
    per.select(record.alias("value"), "status").write.partitionBy("status").text(path)
    return I.metric_files(spark, f"{path}/*/").select("metric", "sub_metric", "value")
