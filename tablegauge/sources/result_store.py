"""A store of result tables: trials, importances, metrics, predictions of many jobs under one path.

Every row is a JSON record beside the schema of its table, under the partitions ``kind`` and
``dataset_id``. Writing a table replaces its own partition; tables of one kind may differ in
their columns, and come back together with the types they were written with.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_COLUMNS = "place long, record string, fields string, kind string, dataset_id string"


def put(df: DataFrame, path: str, kind: str, dataset_id: str | None = None) -> None:
    """Write result rows of one kind in place of what the store has of their data sets.

    ``dataset_id`` names the data set; without it a column of this name does, and only the data
    sets that occur are replaced. An empty table of a named data set leaves nothing of it.
    """
    ids = F.lit(dataset_id) if dataset_id is not None else F.col("dataset_id").cast("string")
    body = df if dataset_id is not None else df.drop("dataset_id")
    record = F.to_json(F.struct(*[F.col(f"`{c}`") for c in body.columns]), {"ignoreNullFields": "false"})
    rows = df.select(F.monotonically_increasing_id().alias("place"), record.alias("record"), F.lit(body.schema.json()).alias("fields"), F.lit(kind).alias("kind"), ids.alias("dataset_id"))
    if dataset_id is not None and not rows.limit(1).count():
        rows = df.sparkSession.createDataFrame([(-1, None, body.schema.json(), kind, dataset_id)], _COLUMNS)  # marks an empty table
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kind", "dataset_id").parquet(path)


def _rows(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(_COLUMNS).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], _COLUMNS)


def get(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """All tables of a kind under each other: ``dataset_id``, then every column with its type.

    Columns that a table lacks are null; of a name with two types the first data set's counts,
    and what does not fit it is null. A store or kind that is not there gives no rows.
    """
    rows = _rows(spark, path).where(F.col("kind") == kind)
    known: dict = {}
    for r in rows.groupBy("fields").agg(F.min("dataset_id").alias("d")).orderBy("d", "fields").collect():  # a row per schema
        for field in StructType.fromJson(json.loads(r["fields"])).fields:
            known.setdefault(field.name, field)
    if not known:
        return rows.select("dataset_id")
    schema = StructType(list(known.values()))
    return rows.where("record is not null").select("dataset_id", F.from_json("record", schema).alias("r")).select("dataset_id", "r.*")


def index(spark: SparkSession, path: str) -> DataFrame:
    """``kind, dataset_id, n_rows, n_columns, position``: what the store holds; positions count data sets of a kind alphabetically from 0."""
    rows = _rows(spark, path)
    n = F.size(F.expr("from_json(get_json_object(fields, '$.fields'), 'array<string>')"))
    each = rows.groupBy("kind", "dataset_id").agg(F.count("record").alias("n_rows"), F.max(n).alias("n_columns"))
    return each.withColumn("position", F.row_number().over(Window.partitionBy("kind").orderBy("dataset_id")) - 1)  # a row per data set


def write_index(spark: SparkSession, path: str, to: str) -> None:
    """The index as JSON lines, one for each table."""
    index(spark, path).coalesce(1).orderBy("kind", "position").write.mode("overwrite").json(to)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """An index that ``write_index`` wrote, to order or look up tables by."""
    return spark.read.schema("kind string, dataset_id string, n_rows long, n_columns int, position int").json(path)
