"""Substring deduplication with one compressed FM-index per shard.

A window is ``window`` consecutive words. All occurrences of a window share its minimizer
(the least hash among its five-word grams), so minimizers deal windows to shards: a run of
windows around one minimizer becomes one short segment, segments of one minimizer meet in
one shard, and no document meets a shard it shares nothing with. Minimizers that occur
once in the corpus are dropped before any text moves.

In each shard an FM-index over its segments is built, and every segment is streamed
through it by backward search, which gives each window's interval of occurrences and the
earliest of them. A word is removed if a window covers it whose text also starts earlier.
Words are told apart by their bytes; hashes only deal them out.

Minimizers with more words around them than one shard holds (``shard_words``) are taken apart: their
windows are dealt out singly by their whole content and a salt. A task that meets the same
run of such windows again knows it for a repeat and does not send its words on; each salted
shard keeps the first of its copies, and only those few meet in a second round.

A document is an id with a text. Ids order documents; where rows of one id have different
texts, the hash of the text orders them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import Words, document_rows, fan_out, grams, text_groups, word_spans, written
from .fm_index import FMIndex

WINDOW, GRAM = 20, 5
#: Words of one shard.
SHARD_WORDS = 250_000
#: Bytes of runs of frequent minimizers that a task remembers.
SEEN_BYTES = 1 << 23
_SEGMENT = "key long, doc_id long, tx long, start int, n int, hot boolean, words binary"
_FOUND = "doc_id long, tx long, start int, n int, words binary"
#: The Arrow types of these columns.
_ARROW = {"key": pa.int64(), "doc_id": pa.int64(), "tx": pa.int64(), "start": pa.int32(), "n": pa.int32(), "hot": pa.bool_(), "words": pa.binary()}


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, _ARROW[c]) for c, v in columns.items()], list(columns))


def window_runs(words: Words, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of windows that share a minimizer: text, key, first window, windows, and whether
    the minimizer occurs more than once in the run, so that windows may repeat inside it.

    Window and word numbers count from each text's first word.
    """
    h = words.hash
    span = window - gram + 1  # grams of a window
    g = grams(h, gram)
    n = len(h) - window + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 5
    value, at, width = g, np.arange(len(g)), 1
    while width < span:  # leftmost minimum over growing spans
        step = min(width, span - width)
        a, b = value[:-step], value[step:]
        right = b < a
        value = np.where(right, b, a)
        at = np.where(right, at[step:], at[:-step])
        width += step
    value, at = value[:n], at[:n]
    owner = np.repeat(np.arange(len(words.first)), words.last - words.first)
    valid = owner[:n] == owner[window - 1 :]
    where = np.flatnonzero(valid)
    if not len(where):
        return (np.zeros(0, np.int64),) * 5
    at, value, own = at[where], value[where], owner[where]
    new = np.r_[True, (value[1:] != value[:-1]) | (where[1:] != where[:-1] + 1)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(where)] - 1
    return own[first], value[first].view(np.int64), where[first] - words.first[own[first]], last - first + 1, at[first] != at[last]


def _runs(docs: DataFrame, window: int) -> DataFrame:
    """``key, dk, at, inner`` of every run of every document; ``at`` is its start and windows, 32 bits each."""

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_groups(batch, "text"):
                own, key, start, n, inner = window_runs(Words(texts), window)
                columns = [key, part.column("dk").to_numpy()[own], start << 32 | n]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns] + [pa.array(inner.astype(bool))], ["key", "dk", "at", "inner"])

    return docs.select("dk", "text").mapInArrow(find, "key long, dk long, at long, inner boolean")


def _packed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``packed`` in place of ``text``: texts compressed before they are shuffled."""
    names = [c for c in docs.columns if c != "text"]

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for part, texts in text_groups(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(c) for c in names] + [pa.array([squeeze(t) for t in texts], pa.binary())], [*names, "packed"])

    return docs.mapInArrow(pack, StructType([docs.schema[c] for c in names] + [StructField("packed", docs.schema["text"].dataType)]))


def _segments(docs: DataFrame, runs: DataFrame, window: int, salts: int) -> DataFrame:
    """The words under each run: ``key, doc_id, tx, start, n, hot, words``.

    A hot run gives a row for each window, keyed by its whole content and a salt; a run that
    the task has met in an earlier document, or earlier in the same, is one row without words.
    """
    # a set: rows that repeat a document repeat its runs; the sign of ``at`` marks the hot ones
    marked = F.when(F.col("hot"), -F.col("at")).otherwise(F.col("at"))
    wanted = runs.groupBy("dk").agg(F.collect_set(F.struct(marked.alias("at"), "key")).alias("runs"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        seen: dict[bytes, tuple[int, int, int]] = {}
        held = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                column = part.column("runs")
                many = column.value_lengths().to_numpy(zero_copy_only=False)
                flat = column.flatten()
                place, key = (flat.field(c).to_numpy() for c in ("at", "key"))
                hot, place = place < 0, np.abs(place)
                start, n = place >> 32, place & 0xFFFFFFFF
                out: list[tuple] = []
                low = 0
                for doc, tx, packed, high in zip(*(part.column(c).to_pylist() for c in ("doc_id", "tx", "packed")), np.cumsum(many).tolist(), strict=True):
                    words = unpack(packed).split()
                    for r in (low + np.argsort(start[low:high])).tolist():
                        s, m = int(start[r]), int(n[r])
                        if s + m + window - 1 > len(words):
                            continue  # a run of another document of the same hash
                        if not hot[r]:
                            out.append((int(key[r]), doc, tx, s, m, False, b" ".join(words[s : s + m + window - 1])))
                            continue
                        content = b" ".join(words[s : s + m + window - 1])
                        first = seen.setdefault(content, (doc, tx, s))
                        if first < (doc, tx, s):
                            out.append((doc, doc, tx, s, m, True, None))
                            continue
                        held += len(content)
                        for p in range(s, s + m):
                            content = b" ".join(words[p : p + window])
                            out.append((xxhash.xxh64_intdigest(content, doc % salts) - (1 << 63), doc, tx, p, 1, True, content))
                    low = high
                    if held > SEEN_BYTES:
                        seen, held = {}, 0
                if out:
                    yield _batch(**dict(zip(_ARROW, zip(*out, strict=True), strict=True)))

    joined = _packed(docs).join(wanted, "dk").select("doc_id", "tx", "packed", "runs")
    return joined.sortWithinPartitions("doc_id", "tx").mapInArrow(cut, _SEGMENT)


class _Shard:
    """Segments in the order of their documents, and which of their windows also start earlier."""

    def __init__(self, rows: pa.Table, window: int):
        doc, tx, start, key = (rows.column(c).to_numpy() for c in ("doc_id", "tx", "start", "key"))
        order = np.lexsort((key, start, tx, doc))
        doc, tx, start, key = doc[order], tx[order], start[order], key[order]
        new = np.r_[True, (doc[1:] != doc[:-1]) | (tx[1:] != tx[:-1]) | (start[1:] != start[:-1]) | (key[1:] != key[:-1])]  # rows repeat
        self.rows = rows.take(pa.array(order[new])).combine_chunks()
        self.doc, self.tx, self.start = doc[new], tx[new], start[new]
        sizes = self.rows.column("n").to_numpy().astype(np.int64) + (window - 1)
        index = FMIndex(_word_ids(self.rows.column("words").combine_chunks()), sizes, window)
        position, found = index.search()
        again = (index.occurrences[found] > 1) & (index.earliest[found] < position)
        position = np.sort(position[again])
        self.segment = np.searchsorted(index.first, position, "right") - 1
        self.offset = position - index.first[self.segment]

    def repeats(self) -> pa.RecordBatch:
        """Runs of windows that also start earlier."""
        segment, offset = self.segment, self.offset
        first = np.flatnonzero(np.r_[True, (segment[1:] != segment[:-1]) | (offset[1:] != offset[:-1] + 1)]) if len(segment) else np.zeros(0, np.int64)
        own = segment[first]
        return _batch(doc_id=self.doc[own], tx=self.tx[own], start=self.start[own] + offset[first], n=np.diff(first, append=len(segment)), words=[None] * len(first))

    def firsts(self, hot: bool = False) -> pa.Table:
        """Segments with a window that is the first of its kind; the ``hot`` ones are single windows."""
        gone = np.bincount(self.segment, minlength=self.rows.num_rows)
        left = self.rows.filter(pa.array(gone < self.rows.column("n").to_numpy()))
        return left.filter(left.column("hot")) if hot else left


def _word_ids(texts: pa.Array) -> np.ndarray:
    """Ids from 1 on of the words of all texts, which are joined by single spaces."""
    raw = b" ".join(texts.to_pylist()) + b" "
    start, _ = word_spans(np.frombuffer(raw, np.uint8))
    ends = np.append(start, len(raw)).astype(np.int32)
    # each word with the space after it, so that the buffer itself is the array's
    words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(raw)])
    return words.dictionary_encode().indices.to_numpy() + 1


def _round(segments: DataFrame, window: int, shard_words: int) -> DataFrame:
    """``doc_id, tx, start, n, words`` of one round over ``segments``.

    Runs of windows that also start earlier have no words; the hot windows that are the
    first of their shard have them. A partition, sorted by key, is cut into shards of whole
    keys. Where one key is too much for a shard, only segments that hold a first window
    stay for those that follow.
    """

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, limit = None, 2 * shard_words
        for batch in batches:
            known = batch.filter(pc.is_null(batch.column("words")))
            if known.num_rows:
                yield known.select(["doc_id", "tx", "start", "n", "words"])
            more = pa.Table.from_batches([batch]).filter(pc.is_valid(batch.column("words")))
            rest = more if rest is None else pa.concat_tables([rest, more])
            while rest.num_rows:
                key = rest.column("key").to_numpy()
                total = np.cumsum(rest.column("n").to_numpy().astype(np.int64) + window)
                if total[-1] <= shard_words:
                    break
                edges = np.flatnonzero(key[1:] != key[:-1]) + 1  # the last key may go on
                if not len(edges):
                    if total[-1] <= limit:
                        break
                    shard = _Shard(rest, window)
                    yield shard.repeats()
                    rest = shard.firsts()
                    limit = 2 * max(shard_words, rest.num_rows * window)
                    break
                at = int(edges[max(0, np.searchsorted(total[edges - 1], shard_words, "right") - 1)])
                yield from out(rest.slice(0, at))
                rest, limit = rest.slice(at), 2 * shard_words
        if rest is not None and rest.num_rows:
            yield from out(rest)

    def out(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        shard = _Shard(rows, window)
        yield shard.repeats()
        yield from shard.firsts(hot=True).select(["doc_id", "tx", "start", "n", "words"]).to_batches()

    dealt = segments.repartition(fan_out(segments.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(search, _FOUND)


def repeated_windows(docs: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``doc_id, tx, start, n``: runs of windows of ``docs(doc_id, tx, text binary)`` that also start earlier."""
    spark = docs.sparkSession
    # what names a document in the runs; two of one hash get each other's runs, which only adds windows to look at
    docs = docs.withColumn("dk", F.xxhash64("doc_id", "tx"))
    runs = _runs(docs, window)
    # a table, so that its join's two sides are plain exchanges, which Spark can split at hot keys
    totals = runs.groupBy("key").agg(F.sum(F.when(F.col("inner"), 2).otherwise(1)).alias("times"), F.sum(F.col("at").bitwiseAND(0xFFFFFFFF) + window).alias("words"))
    often = written(totals.where("times > 1").select("key", (F.col("words") > shard_words).alias("hot")), "minimizers")
    shared = runs.drop("inner").join(often, "key")
    found = written(_round(_segments(docs, shared, window, fan_out(spark, 16)), window, shard_words), "repeats")
    out = found.where("words is null").drop("words")
    rest = found.where("words is not null")
    if rest.limit(1).count() == 0:
        return out
    # survivors of the salted shards meet by their content: at most one a salt and task
    again = _round(rest.select(F.xxhash64("words").alias("key"), "doc_id", "tx", "start", "n", F.lit(True).alias("hot"), "words"), window, shard_words)
    return out.unionByName(again.where("words is null").drop("words"))


def _tx(text: Column) -> Column:
    """What tells texts of one id apart."""
    return F.xxhash64(text)


def removal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``doc_id, tx, cuts``: for documents that lose words, the runs of windows to remove."""
    rows = document_rows(docs, id_col, text_col).where("doc_id is not null and text is not null").withColumn("tx", _tx(F.col("text")))
    cuts = repeated_windows(rows, window, shard_words)
    return written(cuts.groupBy("doc_id", "tx").agg(F.collect_list(F.struct("start", "n")).alias("cuts")), "cuts")


def keep_mask(n_words: int, cuts: Iterable, window: int) -> np.ndarray:
    """Which words stay."""
    keep = np.ones(n_words, bool)
    for c in cuts:
        keep[c["start"] : c["start"] + c["n"] + window - 1] = False
    return keep


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept`` for every row of ``docs``.

    ``kept`` is the remaining words joined by one space. Words are ``[^\\x20\\x09-\\x0D]+``,
    unchanged; null texts have none. "Earlier" is a smaller id, or an earlier start in the
    same document. Rows that repeat an id and text are one document and each get its result;
    rows of one id with different texts are documents of their own, in the order of a hash of
    the text. Rows with a null id are kept whole. Texts may have any length. Other columns are
    ignored, whatever their names; an empty table gives an empty result.
    """
    rows = document_rows(docs, id_col, text_col).withColumn("tx", _tx(F.col("text")))
    cuts = removal(docs, id_col, text_col, window, shard_words)

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = []
                for packed, found in zip(part.column("packed").to_pylist(), part.column("cuts").to_pylist(), strict=True):
                    words = unpack(packed).split()
                    left = list(compress(words, keep_mask(len(words), found, window).tolist())) if found else words
                    kept = b" ".join(left)
                    out.append((len(words), len(words) - len(left), hashlib.sha256(kept).hexdigest(), kept))
                n_words, n_removed, digest, kept = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    joined = _packed(rows).join(cuts, ["doc_id", "tx"], "left").select("doc_id", "packed", "cuts")
    return joined.mapInArrow(apply, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` with repeated windows removed from its texts, in the columns of ``docs``.

    A text that loses nothing is unchanged; another becomes its remaining words joined
    by one space, none of them if all go. ``n_chars``, where there is one, follows. Edge
    cases are those of ``deduplicated``.
    """
    cuts = removal(docs, id_col, text_col, window, shard_words)
    # own names for what is joined on, beside whatever columns there are
    ours = [f"__{'_' * max(map(len, docs.columns))}{c}" for c in cuts.columns]
    cuts = cuts.toDF(*ours)
    on = (docs[id_col].cast("long") == cuts[ours[0]]) & (_tx(docs[text_col].cast("string").cast("binary")) == cuts[ours[1]])
    joined = docs.join(cuts, on, "left").select(*[docs[c] for c in docs.columns], cuts[ours[2]])
    names, counted = docs.columns, "n_chars" in docs.columns

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_groups(batch, text_col):
                columns = {c: part.column(c) for c in names}
                cut = np.flatnonzero(pc.is_valid(part.column(ours[2])).to_numpy(zero_copy_only=False))
                if len(cut):
                    made, chars = columns[text_col].to_pylist(), columns["n_chars"].to_pylist() if counted else []
                    for k, found in zip(cut.tolist(), part.column(ours[2]).take(pa.array(cut)).to_pylist(), strict=True):
                        words = texts[k].split()
                        made[k] = b" ".join(compress(words, keep_mask(len(words), found, window).tolist())).decode()
                        if counted:
                            chars[k] = len(made[k])
                    columns[text_col] = pa.array(made, columns[text_col].type)
                    if counted:
                        columns["n_chars"] = pa.array(chars, columns["n_chars"].type)
                yield pa.RecordBatch.from_arrays(list(columns.values()), names)

    return joined.mapInArrow(apply, docs.schema)
