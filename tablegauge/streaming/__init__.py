"""Row-local operators on streams.

Nothing here keeps state: the scalar functions, port binning and encodings by a stored
map are projections and stream-static joins, so they take a streaming DataFrame as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import port_service


def binned_ports(stream: DataFrame, columns: list[str]) -> DataFrame:
    """Port columns of a stream as services."""
    return stream.withColumns({c: port_service(F.col(c)) for c in columns})


def encoded_by_map(stream: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """A stream's column encoded by a stored ``value, code`` table; unseen values are -1."""
    codes = mapping.select(F.col("value").alias(column), "code")
    return stream.join(codes, column, "left").withColumn("code", F.coalesce("code", F.lit(-1)))
