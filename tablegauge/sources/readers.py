"""Scans of raw files: delimited text in its many shapes, Parquet, and JSON results."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def csv_with_header(spark: SparkSession, path: str, schema: T.StructType | None = None, skip_malformed: bool = False, sep: str = ",") -> DataFrame:
    """A file or a folder of files with header lines; all text unless a schema is given."""
    reader = spark.read.option("header", True).option("sep", sep).option("mode", "DROPMALFORMED" if skip_malformed else "PERMISSIVE")
    return (reader.schema(schema) if schema else reader).csv(path)


def csv_named(spark: SparkSession, path: str, names: list[str], sep: str = ",", comment: str | None = None) -> DataFrame:
    """A file without header lines, all text, its columns named."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    reader = spark.read.schema(schema).option("sep", sep)
    return (reader.option("comment", comment) if comment else reader).csv(path)


def names_from_line(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """Column names in the first line of a side file."""
    first = spark.read.text(path).first()
    return [] if first is None else [n.strip() for n in first[0].split(sep)]


def names_from_pattern(spark: SparkSession, path: str, pattern: str) -> list[str]:
    """Column names out of a feature description: the pattern's first group of each matching line."""
    rows = spark.read.text(path).select(F.regexp_extract("value", pattern, 1).alias("n")).where("n <> ''")
    return [r["n"].strip() for r in rows.collect()]  # a line per column


def folder(spark: SparkSession, path: str, pattern: str | None = None, recursive: bool = False, matches: str | None = None) -> DataFrame:
    """All files of a folder as one table, by glob and, if given, by a regular expression on the name."""
    reader = spark.read.option("header", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    df = reader.csv(path)
    return df.where(F.col("_metadata.file_name").rlike(matches)) if matches else df


def without_repeated_headers(df: DataFrame, column: str) -> DataFrame:
    """Rows but header lines that occur again inside a file."""
    return df.where(F.col(column).isNull() | (F.col(column) != column))


def label_from_name(pattern: str, group: int = 1) -> Column:
    """A label out of the file's name."""
    return F.regexp_extract(F.col("_metadata.file_name"), pattern, group)


def label_from_path(pattern: str, group: int = 1) -> Column:
    """A label out of the file's whole path, for instance its folder."""
    return F.regexp_extract(F.col("_metadata.file_path"), pattern, group)


#: Fixed value: the name before a number and a split's suffix.
TRAIN_TEST_NAME = r"^(.*?)(?:\d+)?(?=_test|_train)"


def restored(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Columns cast to recorded types; a value that does not fit is null."""
    return df.select(*[F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(c) for c in df.columns])


def metric_files(spark: SparkSession, path: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """``dataset_id, metric, sub_metric, value`` of a folder of JSON results; ``errors`` lists give nothing."""
    text = spark.read.option("wholetext", True).text(path).select(F.regexp_replace(F.col("_metadata.file_name"), r"(_complexity\w*)?\.json$", "").alias("dataset_id"), "value")
    for word in exclude:
        text = text.where(~F.col("dataset_id").contains(word))
    outer = text.select("dataset_id", F.explode(F.from_json("value", "map<string,string>")).alias("metric", "inner")).where("metric <> 'errors'")
    return outer.select("dataset_id", "metric", F.explode(F.from_json("inner", "map<string,double>")).alias("sub_metric", "value"))


def cached(spark: SparkSession, make, path: str, rebuild: bool = False) -> DataFrame:
    """A table converted to Parquet once, then read from there."""
    from pyspark.errors import AnalysisException

    if not rebuild:
        try:
            return spark.read.parquet(path)
        except AnalysisException:
            pass
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def safe_name(name: str) -> str:
    """A name usable as a folder."""
    return re.sub(r"[^A-Za-z0-9._-]", "_", name)
