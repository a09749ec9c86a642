"""Shared helpers: vectorised word splitting, batch grouping and written tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_POWERS = np.ones(1, np.uint64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, by a path that only Spark's reader opens."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where unset, a temporary one for a local master.

    Raises ``RuntimeError`` on a cluster that names no shared folder.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='checkpoints-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def unwritten(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made; for those whose every reader has itself been written."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fan_out(spark: SparkSession, least: int = 1) -> int:
    """Partitions for a shuffle that states its own number."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.cumprod(np.r_[np.uint64(1), np.full(max(n, 64), _STEP)], dtype=np.uint64)
    return _POWERS


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words ``[^\\x20\\x09-\\x0D]+`` in a byte buffer."""
    solid = np.empty(len(buf) + 2, bool)
    solid[0] = solid[-1] = False
    np.logical_not(_SPACE[buf], out=solid[1:-1])
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    return edge[::2], edge[1::2]


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from its bytes alone."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    ends = np.cumsum(size)
    at = np.arange(int(ends[-1])) - np.repeat(ends - size, size)
    power = _powers(int(size.max()) + 1)
    part = _BYTE[buf[np.repeat(start, size) + at]] * power[at]
    return mix(np.add.reduceat(part, ends - size) + size.astype(np.uint64))


class Words:
    """The words of several texts: hashes, and where each text's words begin and end.

    Texts are joined by a newline, so no word spans two of them.
    """

    def __init__(self, texts: list[bytes]):
        self.raw = b"\n".join(texts)
        self.buf = np.frombuffer(self.raw, np.uint8)
        self.start, self.end = word_spans(self.buf)
        self.hash = word_hashes(self.buf, self.start, self.end)
        limit = np.cumsum([len(t) + 1 for t in texts])
        self.last = np.searchsorted(self.start, limit)  # words of text k: first[k]..last[k]
        self.first = np.r_[0, self.last[:-1]]


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive word hashes; empty if there are fewer."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    acc = np.zeros(m, np.uint64)
    for j in range(n):
        acc = acc * _STEP + h[j : m + j]
    return mix(acc)


def chunks(rows: Iterable[tuple], limit: int = 1 << 20) -> Iterator[list[tuple]]:
    """Group rows whose last field is the text's bytes, up to about ``limit`` bytes a group."""
    got, size = [], 0
    for row in rows:
        got.append(row)
        size += len(row[-1])
        if size >= limit:
            yield got
            got, size = [], 0
    if got:
        yield got


def as_bytes(value: bytes | None) -> bytes:
    """A binary cell; null is empty."""
    return b"" if value is None else bytes(value)


def text_groups(batch: pa.RecordBatch, column: str, step: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of an Arrow batch of about ``step`` bytes of text each, and their texts; null is empty."""
    text = batch.column(column)
    if not pa.types.is_binary(text.type):
        text = pc.cast(pc.cast(text, pa.string()), pa.binary())
    ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + step, "right")))
        yield batch.slice(at, to - at), [b"" if t is None else t for t in text.slice(at, to - at).to_pylist()]
        at = to


def with_computed(rows: DataFrame, compute: Callable[[list[bytes]], dict], schema: str, text_col: str = "text", keep: bool = False) -> DataFrame:
    """``rows`` with the columns that ``compute`` makes of their texts in place of ``text_col`` (beside it: ``keep``).

    ``compute`` gets some texts as bytes and returns the columns of ``schema`` by name. All
    else passes as Arrow, so 64-bit ids stay exact beside nulls. Rows keep their number.
    """
    names = [c for c in rows.columns if keep or c != text_col]
    made = StructType.fromDDL(schema)
    fields = to_arrow_schema(made)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_groups(batch, text_col):
                columns = compute(texts)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in names] + [pa.array(columns[f.name], f.type) for f in fields], names + fields.names)

    return rows.mapInArrow(run, StructType([rows.schema[c] for c in names] + made.fields))


def filtered(docs: DataFrame, text_col: str, stays: Callable[[list[bytes]], np.ndarray]) -> DataFrame:
    """The rows of ``docs`` for whose texts ``stays`` says so, with all their columns."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_groups(batch, text_col):
                yield part.filter(pa.array(np.asarray(stays(texts), bool)))

    return docs.mapInArrow(run, docs.schema)


def document_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text``: ids as longs, texts as bytes."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))


def dealt_join(left: DataFrame, right: DataFrame, on: str | list[str] | Column, how: str = "inner") -> DataFrame:
    """A join that deals out both sides and broadcasts neither, for sides that grow with the input.

    Spark takes an exploded table to be as large as before, and a written one as its
    compressed files, so that it would broadcast many times what it is allowed to.
    """
    return left.join(right.hint("merge"), on, how)


def with_frequent_apart(rows: DataFrame, named: DataFrame, key: str, count: str, how: str = "inner", deal: bool = False) -> DataFrame:
    """``rows`` joined with ``named``, which has one row for each ``key``, and its ``count`` among ``rows``.

    Keys of over a thousandth of all rows, of which there are less than a thousand, are
    broadcast, so that no task gets all rows of one of them. ``deal`` never broadcasts the others.
    """
    total = named.agg(F.sum(count)).first()[0] or 0
    often = named.where(F.col(count) * 1000 > total)
    apart = rows.join(F.broadcast(often.drop(count)), key)
    rest = rows.join(F.broadcast(often.select(key)), key, "left_anti")
    return (dealt_join if deal else DataFrame.join)(rest, named.drop(count), key, how).unionByName(apart)


class Memory(dict):
    """A dictionary of bounded size that forgets what was not asked for of late.

    Keys of over ``LONGEST`` characters are not kept, which bounds its bytes.
    """

    LONGEST = 64

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        if len(key) > self.LONGEST:
            return self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        value = self[key] = self.old[key] if key in self.old else self.make(key)
        return value
