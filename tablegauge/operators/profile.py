"""Column profiles: one aggregate over all columns, and the rules that read it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import IPV4, IPV6, MAC
from .clean import columns_of

_WIDTH = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8, "boolean": 1, "timestamp": 8, "date": 4}
# Parts of column names that speak of ports, and parts that speak of something else.
PORT_NAMES = ("srcport", "dstport", "src_port", "dst_port", "sport", "dport", "srcp", "dstp", "src-p", "dst-p", "port", "prt", "orig_p", "resp_p")
NO_PORT_NAMES = ("rate", "ltm", "is_", "ct_", "flag", "type", "pkts", "rtt", "time", "ttl", "len", "bytes", "flow", "duration")


def per_column(df: DataFrame, measures: dict[str, object]) -> DataFrame:
    """``column`` and the measures of each column, from one pass: name -> function of a column."""
    row = df.agg(*[f(F.col(f"`{c}`")).alias(f"{i}_{m}") for i, c in enumerate(df.columns) for m, f in measures.items()])
    items = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{i}_{m}").alias(m) for m in measures]) for i, c in enumerate(df.columns)])
    return row.select(F.explode(items).alias("x")).select("x.*")


def column_profile(df: DataFrame) -> DataFrame:
    """Rows, nulls, distinct values, type and estimated bytes of every column."""
    kinds = dict(df.dtypes)
    out = per_column(df, {
        "n": lambda c: F.count(F.lit(1)),
        "n_null": lambda c: F.sum(c.isNull().cast("bigint")),
        "n_distinct": lambda c: F.count_distinct(c),
        "n_bytes": lambda c: F.sum(F.coalesce(F.octet_length(c.cast("string")), F.lit(0)).cast("bigint")),
    })
    kind = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("column")]
    width = F.create_map(*[F.lit(x) for kv in _WIDTH.items() for x in kv])[kind]
    return out.select("column", kind.alias("dtype"), "n", "n_null", "n_distinct", F.coalesce(width * F.col("n"), F.col("n_bytes")).alias("bytes"))


def castability(df: DataFrame) -> DataFrame:
    """Of each column: its values, and those that read as whole and as decimal numbers."""
    text = lambda c: F.trim(c.cast("string"))
    return per_column(df, {
        "n": lambda c: F.count(c),
        "n_integer": lambda c: F.count(F.when(text(c).rlike(r"^[+-]?[0-9]{1,18}$"), 1)),
        "n_number": lambda c: F.count(text(c).try_cast("double")),
        "n_distinct": lambda c: F.count_distinct(c),
    })


def infer_types(df: DataFrame) -> DataFrame:
    """``column, kind``: integer, float, or categorical, by the values alone."""
    c = castability(df)
    kind = F.when(F.col("n") == 0, "unknown").when(F.col("n_integer") == F.col("n"), "integer").when(F.col("n_number") == F.col("n"), "float").otherwise("categorical")
    return c.select("column", kind.alias("kind"), "n_distinct")


def numeric_text(df: DataFrame) -> DataFrame:
    """Text columns as numbers where every value is one; others unchanged."""
    text = columns_of(df, "text")
    if not text:
        return df
    whole = {r["column"] for r in castability(df.select(*text)).where("n = n_number and n > 0").collect()}  # a row per column
    return df.select(*[F.col(c).cast("double").alias(c) if c in whole else F.col(c) for c in df.columns])


def identifier_columns(df: DataFrame, target: str) -> DataFrame:
    """Columns of whole numbers or texts in which every row differs; never the target."""
    kinds = {c for c, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint", "string") and c != target}
    p = column_profile(df)
    return p.where(F.col("column").isin(*kinds) & (F.col("n_distinct") == F.col("n"))).select("column", "n", "n_distinct")


def near_unique(df: DataFrame, least: float = 0.999) -> DataFrame:
    """Columns whose distinct share is at least ``least``, but not one."""
    share = F.col("n_distinct") / F.col("n")
    return column_profile(df).where((share >= least) & (share < 1)).select("column", "n", "n_distinct")


def pattern_shares(df: DataFrame, test, least: float | None = None) -> DataFrame:
    """Share of each text column's values that pass a test; those above ``least`` if given."""
    out = per_column(df.select(*columns_of(df, "text")), {"share": lambda c: F.avg(test(c).cast("int"))})
    return out if least is None else out.where(F.col("share") > least)


def is_ip(c: Column) -> Column:
    """Whether a text is an IPv4 or IPv6 address."""
    return c.rlike(IPV4) | c.rlike(IPV6)


def is_mac(c: Column) -> Column:
    """Whether a text is a MAC address, with or without separators."""
    return c.rlike(MAC)


def port_like(df: DataFrame, least: float = 0.95) -> DataFrame:
    """Numeric columns named like ports whose values are mostly in range, with that share."""
    named = [c for c in columns_of(df, "number") if any(w in c.lower() for w in PORT_NAMES) and not any(w in c.lower() for w in NO_PORT_NAMES)]
    out = per_column(df.select(*named), {"share": lambda c: F.avg(c.between(0, 65535).cast("int"))})
    return out.where(F.col("share") > least)


def fit_width(df: DataFrame, unsigned: bool = False) -> DataFrame:
    """The narrowest whole-number type that holds each column's values.

    ``unsigned`` names widths for files and arrays (``uint8`` .. ``int64``), as Spark has signed types only.
    """
    whole = [c for c, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint")]
    out = per_column(df.select(*whole), {"least": lambda c: F.min(c.cast("bigint")), "most": lambda c: F.max(c.cast("bigint"))})
    fits = lambda bits: (F.col("least") >= -(2 ** (bits - 1))) & (F.col("most") < 2 ** (bits - 1))
    if unsigned:
        below = lambda bits: (F.col("least") >= 0) & (F.col("most") < 2**bits)
        plain = F.when(below(8), "uint8").when(below(16), "uint16").when(below(32), "uint32").when(F.col("least") >= 0, "uint64")
        return out.select("column", plain.when(fits(8), "int8").when(fits(16), "int16").when(fits(32), "int32").otherwise("int64").alias("width"))
    return out.select("column", F.when(fits(8), "tinyint").when(fits(16), "smallint").when(fits(32), "int").otherwise("bigint").alias("width"))


def shrink(df: DataFrame, narrowest: bool = False) -> DataFrame:
    """Numbers cast to 32 bits where they fit, or to the narrowest type that holds them."""
    fit = {r["column"]: r["width"] for r in fit_width(df).collect()}  # a row per column

    def to(name: str, kind: T.DataType) -> Column:
        if name in fit:
            width = fit[name] if narrowest or fit[name] == "bigint" else "int"
            return F.col(name).cast(width)
        return F.col(name).cast("float") if isinstance(kind, T.DoubleType) else F.col(name)

    return df.select(*[to(f.name, f.dataType).alias(f.name) for f in df.schema])


def low_variance(df: DataFrame, label: str, least: float = 0.1) -> DataFrame:
    """Numeric columns, the label aside, of a population variance below ``least``."""
    out = per_column(df.select(*[c for c in columns_of(df, "number") if c != label]), {"variance": lambda c: F.var_pop(c)})
    return out.where(F.col("variance") < least)


def catalogue(tables: dict[str, DataFrame]) -> DataFrame:
    """``name, kinds, n_columns, n_rows, bytes`` of some tables, smallest first."""
    out = None
    for name, df in tables.items():
        p = column_profile(df)
        row = p.agg(F.concat_ws(",", F.array_sort(F.collect_set("dtype"))).alias("kinds"), F.count("*").alias("n_columns"), F.max("n").alias("n_rows"), F.sum("bytes").alias("bytes")).select(F.lit(name).alias("name"), "*")
        out = row if out is None else out.unionByName(row)
    return out.orderBy("bytes", "name")
