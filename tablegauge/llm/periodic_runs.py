"""Runs of repeated words, from string synchronising sets at dyadic scales.

A run is a stretch of words of smallest period ``q`` that no neighbour extends; those of at
least ``4 q`` words are found. Periods up to ``DIRECT`` are found by comparing a document with
itself shifted. A longer period ``p`` belongs to the scale ``P`` with ``P / 2 < p <= P``:

* ``t = P / 4``. A position is in the scale's synchronising set if the least hash of the
  ``t``-word fragments that begin at it or up to ``t`` words later is that of the first or of
  the last of them. Fragments of a period of at most ``t / 4`` take no part. Whether a
  position is in the set depends on its next ``2 t`` words alone.
* Without such fragments, any ``t`` neighbouring positions hold one of the set. A stretch
  without any has a period of at most ``t / 4``, and inside a run of period ``p`` it is
  shorter than ``p - t`` words (else ``p`` were not the smallest period). So a run of
  ``4 p`` words has a position ``s`` of the set with ``s + p`` and both their next ``P`` words inside.
* ``s + p`` is then the next position of the set with the same ``P`` words: a nearer one would
  turn the period onto itself. Equal neighbours by context propose ``p``, which is extended
  both ways on the words themselves.

The fragments left out are those of runs of smaller periods, which are known by then. Many
documents are handled as one array; a word of its own parts each two of them.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, with_computed, word_spans

#: Longest period that is found by comparing shifted documents.
DIRECT = 8
#: A run has at least so many periods, and so many words.
PERIODS, LEAST = 4, 6
_COLUMNS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _distinct(starts: np.ndarray, lengths: np.ndarray, periods: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each stretch once, with its smallest period."""
    order = np.lexsort((periods, lengths, starts))
    s, n, q = starts[order], lengths[order], periods[order]
    new = np.r_[True, (s[1:] != s[:-1]) | (n[1:] != n[:-1])] if len(s) else np.zeros(0, bool)
    return s[new], n[new], q[new]


def _stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the stretches of true values."""
    edge = np.flatnonzero(np.diff(np.r_[False, same, False]))
    return edge[::2], edge[1::2] - edge[::2]


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values, for every full window."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values


def _reach(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading values agree; compares doubling parts."""
    n, at, step = min(len(a), len(b)), 0, 64
    a, b = a[:n], b[:n]
    while at < n:
        differs = np.flatnonzero(a[at : at + step] != b[at : at + step])
        if len(differs):
            return at + int(differs[0])
        at, step = at + step, step * 2
    return n


class _Hashes:
    """Hashes of the fragments of ``n`` words from every position, for lengths that are powers of two."""

    def __init__(self, words: np.ndarray):
        self.n, self.value = 1, mix(words.astype(np.uint64) + _STEP)

    def to(self, n: int) -> np.ndarray:
        while self.n < n:
            self.value = mix(self.value[: -self.n] * _STEP + self.value[self.n :])
            self.n *= 2
        return self.value


def _proposed(words: np.ndarray, scale: int, fragment: np.ndarray, context: np.ndarray, known: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Positions and distances up to ``scale``, over its half, of equal contexts that follow each other."""
    t = scale // 4
    part = fragment.copy()  # fragments of t words
    start, length, period = known
    short = (period * 4 <= t) & (length >= t)
    if short.any():
        edge = np.zeros(len(words) + 1, np.int32)
        np.add.at(edge, start[short], 1)
        np.add.at(edge, start[short] + length[short] - t + 1, -1)
        part[np.cumsum(edge[: len(part)]) > 0] = np.uint64(2**64 - 1)
    n = len(context)
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = _least(part, t + 1)[:n]
    left_out = np.uint64(2**64 - 1)
    s = np.flatnonzero(((part[:n] == least) | (part[t : n + t] == least)) & (least != left_out))
    key = context[s]
    order = np.argsort(key, kind="stable")
    s, key = s[order], key[order]
    apart = s[1:] - s[:-1]
    good = (key[1:] == key[:-1]) & (2 * apart > scale) & (apart <= scale)
    return s[:-1][good], apart[good]


def _extended(words: np.ndarray, at: np.ndarray, period: np.ndarray, span: int) -> list[tuple[int, int, int]]:
    """The stretches ``start, length, period`` around proposals whose words do repeat; parting words stop them."""
    out, last, end = [], -1, -1
    back = words[::-1]
    size = len(words)
    for p, s in sorted(zip(period.tolist(), at.tolist(), strict=True)):
        if p == last and s < end:
            continue  # inside the stretch just found
        right = _reach(words[s:], words[s + p :])
        left = _reach(back[size - s :], back[size - s - p :])
        if right + left >= (PERIODS - 1) * p:
            out.append((s - left, left + right + p, p))
        last, end = p, s + right
    return out


def found_runs(words: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and smallest periods of all stretches of at least ``4 q`` words of one period ``q``.

    ``words`` are ids with an id of its own after each document; documents are ``words[first[k]:last[k]]``.
    Sorted by start, then period.
    """
    found = [np.zeros((0, 3), np.int64)]
    for q in range(1, DIRECT + 1):
        if len(words) < PERIODS * q:
            break
        start, many = _stretches(words[:-q] == words[q:])
        long = many >= (PERIODS - 1) * q
        found.append(np.stack([start[long], many[long] + q, np.full(int(long.sum()), q)], axis=1))
    known = _distinct(*np.concatenate(found).T)
    scale, sizes = 2 * DIRECT, last - first
    ids, place, hashes = words, None, _Hashes(words)
    while True:
        large = sizes >= PERIODS * (scale // 2 + 1)
        if not large.any():
            break
        if 2 * int((sizes[large] + 1).sum()) <= len(ids):  # go on with the documents that are long enough
            inside = np.zeros(len(words) + 1, np.int8)
            inside[first[large]] += 1
            inside[last[large] + 1] -= 1
            place = np.flatnonzero(np.cumsum(inside[:-1]))
            ids, hashes = words[place], _Hashes(words[place])
        near = known
        if place is not None:
            kept = np.flatnonzero(np.isin(known[0], place))
            near = (np.searchsorted(place, known[0][kept]), known[1][kept], known[2][kept])
        if len(ids) >= 2 * scale:
            fragment = hashes.to(scale // 4)
            context = _Hashes.__new__(_Hashes)
            context.n, context.value = hashes.n, fragment
            at, period = _proposed(ids, scale, fragment, context.to(scale), near)
            more = _extended(ids, at, period, scale)
            if more:
                s, n, q = np.array(more, np.int64).T
                s = s if place is None else place[s]
                known = _distinct(np.r_[known[0], s], np.r_[known[1], n], np.r_[known[2], q])
        scale *= 2
    order = np.lexsort((known[2], known[0]))
    return known[0][order], known[1][order], known[2][order]


def _ids(raw: bytes, limits: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word ids with a new id after each text, and each text's first and last place."""
    size = end - start
    packed = b"".join([raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)])
    offsets = np.r_[0, np.cumsum(size)].astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
    code = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    last = np.searchsorted(start, limits)
    first = np.r_[0, last[:-1]]
    texts = len(limits)
    own = np.repeat(np.arange(texts), last - first)
    ids = np.empty(len(code) + texts, np.int64)
    ids[np.arange(len(code)) + own] = code
    first, last = first + np.arange(texts), last + np.arange(texts)
    ids[last] = len(code) + np.arange(texts)
    return ids, first, last


def described(texts: list[bytes], keep_text: bool = False) -> dict[str, list]:
    """The result columns of some texts; ``collapsed`` with ``keep_text``."""
    raw = b"\n".join(texts)
    start, end = word_spans(np.frombuffer(raw, np.uint8))
    ids, first, last = _ids(raw, np.cumsum([len(t) + 1 for t in texts]), start, end)
    s, n, q = found_runs(ids, first, last)
    enough = n >= LEAST
    s, n, q = s[enough], n[enough], q[enough]
    dropped = np.zeros(len(ids) + 1, np.int32)
    np.add.at(dropped, s + q, 1)
    np.add.at(dropped, s + n, -1)
    stays = np.cumsum(dropped[:-1]) == 0
    owner = np.searchsorted(first, s, "right") - 1
    low = np.searchsorted(owner, np.arange(len(texts)))
    high = np.searchsorted(owner, np.arange(len(texts)), "right")
    out: dict[str, list] = {c.split()[0]: [] for c in _COLUMNS.split(", ")} | {"runs": [], "collapsed": []}
    for k, text in enumerate(texts):
        mine = list(zip((s[low[k] : high[k]] - first[k]).tolist(), n[low[k] : high[k]].tolist(), q[low[k] : high[k]].tolist(), strict=True))
        best = min(mine, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        words = text.split()
        kept = b" ".join(compress(words, stays[first[k] : last[k]].tolist()) if mine else words)
        out["n_runs"].append(len(mine))
        for c, v in zip(("start", "length", "period"), best, strict=True):
            out[c].append(v)
        out["exponent_milli"].append(1000 * best[1] // best[2] if mine else None)
        out["runs_sha256"].append(hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in mine).encode()).hexdigest())
        out["collapsed_sha256"].append(hashlib.sha256(kept).hexdigest())
        if keep_text:
            out["runs"].append([{"start": a, "length": b, "period": c} for a, b, c in mine])
            out["collapsed"].append(kept.decode())
    return out


def runs_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``runs`` (start, length, period of each), ``collapsed`` and their digests, for every row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+``, compared by their bytes. ``collapsed`` is a text's words
    joined by one space without those that a run contains after its first period. ``start``,
    ``length``, ``period`` and ``exponent_milli`` are of the longest run (ties: the earlier start,
    then the smaller period), null if there is none. Null and empty texts have no words and no
    run. Rows are judged one by one: ids may be null or repeat. Texts may have any length; other
    columns are ignored, whatever their names. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return with_computed(rows, lambda texts: described(texts, True), _COLUMNS + ", runs array<struct<start: long, length: long, period: long>>, collapsed string")


def with_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with periods written into every tenth text, by the checksum of its id.

    With ``h = crc32(decimal id)``, ``g = h // 10`` and ``n`` words, a text with ``h % 10 = 0`` and
    ``n > 0`` keeps its words up to ``a = g % n``; from there on, word ``i`` becomes word
    ``a + (i - a) % p``, ``p = 1 + (n - a) // (3 + g % 8)``. Its words are joined by one space.
    Rows with a null id are left alone.
    """
    h = F.crc32(F.col(id_col).cast("long").cast("string").cast("binary"))
    rows = docs.withColumn("__h", h).withColumn("__g", F.floor(F.col("__h") / 10).cast("long"))
    words = F.filter(F.split(F.when(F.col("__h") % 10 == 0, F.col(text_col)), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    rows = rows.withColumn("__w", words).withColumn("__n", F.size("__w").cast("long"))
    rows = rows.withColumn("__a", F.when(F.col("__n") > 0, F.col("__g") % F.col("__n")))
    rows = rows.withColumn("__p", (1 + F.floor((F.col("__n") - F.col("__a")) / (3 + F.col("__g") % 8))).cast("long"))
    i = F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)
    cell = lambda k: F.get("__w", F.when(k < F.col("__a"), k).otherwise(F.col("__a") + (k - F.col("__a")) % F.col("__p")).cast("int"))
    return rows.withColumn(text_col, F.when(F.col("__n") > 0, F.array_join(F.transform(i, cell), " ")).otherwise(F.col(text_col))).select(*docs.columns)
