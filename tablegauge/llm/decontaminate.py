"""Benchmark decontamination: size-partitioned MinHash containment search.

Items are partitioned by size. For the partition of items with ``u/2 < n <= u`` shingles
a document is read as overlapping windows of ``2u`` shingles, ``u`` apart, so any run of
an item's length lies inside one window and a contained item's Jaccard similarity to it
is bounded from below: with containment ``c``, at least ``c n / (2u + (1 - c) n)``, above
``c / (5 - c)``. One band per MinHash function then misses a contained item with a
probability of at most ``(1 - c / (5 - c)) ** bands``. The smallest partition's windows are
wider than items of few shingles ask for, so those are looked up by their shingles' hashes,
which misses none. Candidates are verified by exact shingle containment in the whole document.

Items are taken in blocks of a bounded number and size, so the broadcast has a size bound
whatever the benchmark: a larger benchmark makes more passes, each written before the next.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, as_bytes, document_rows, filtered, grams, mix, text_groups, written

SHINGLE, CONTAINMENT, BANDS = 5, 0.8, 64
#: Items and bytes of their texts of one pass: signatures take about half a kilobyte an item and band tables as much.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 16 << 20
#: Items of so many shingles are looked up; the smallest partition holds those of up to twice as many.
FEW = 4
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def _seeds(bands: int) -> np.ndarray:
    return mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def item_shingles(text: bytes, n: int = SHINGLE) -> list[bytes]:
    """Distinct shingles of ``n`` words, space-joined; fewer words make one shingle, none none."""
    words = text.lower().split()
    if not words:
        return []
    return list(dict.fromkeys(b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))))


class ItemIndex:
    """Signatures of a block of items, by size partition and band."""

    def __init__(self, items: list[tuple[int, bytes]], n: int, bands: int):
        self.n, self.bands = n, bands
        self.short_hash: dict[int, dict[int, list[int]]] = {}  # looked-up items, by words a shingle and its hash
        self.items = [(i, s) for i, t in items if (s := item_shingles(t, n))]
        self.by_size: dict[int, list[int]] = {}
        hashed = []
        for k, (_, shingles) in enumerate(self.items):
            words = Words([shingles[0]])
            if len(words.hash) < n:
                hashed.append(grams(words.hash, len(words.hash)))
            else:
                hashed.append(np.concatenate([grams(Words([s]).hash, n) for s in shingles]))
            if len(shingles) <= FEW:
                by_hash = self.short_hash.setdefault(min(n, len(words.hash)), {})
                for h in set(hashed[-1].tolist()):
                    by_hash.setdefault(h, []).append(k)
            else:
                self.by_size.setdefault(max(2 * FEW, 1 << int(len(shingles) - 1).bit_length()), []).append(k)
        self.hashed = hashed
        seeds = _seeds(bands)
        # for each size and band: sorted minima, the item of each, and which leading bits occur
        self.tables: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for size, members in self.by_size.items():
            where = np.array(members)
            table = []
            for s in seeds:
                minima = np.array([(hashed[k] * s).min() for k in members], np.uint64)
                order = np.argsort(minima, kind="stable")
                marked = np.zeros(1 << 16, bool)
                marked[minima >> np.uint64(48)] = True
                table.append((minima[order], where[order], marked))
            self.tables[size] = table

    def candidates(self, words: Words) -> set[tuple[int, int]]:
        """``(text, item)`` pairs that share a minimum with a window."""
        found: set[tuple[int, int]] = set()
        n, h = self.n, words.hash
        if not len(h):
            return found
        owner = np.repeat(np.arange(len(words.first)), words.last - words.first)
        g = grams(h, n)
        whole = owner[: len(g)] == owner[n - 1 :] if len(g) else np.zeros(0, bool)  # not across two texts
        if whole.any() and self.tables:
            g, own = g[whole], owner[: len(whole)][whole]
            seeds, sizes = _seeds(self.bands), sorted(self.tables)
            # blocks of the smallest size; larger windows join several of them
            unit = sizes[0]
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            length = np.diff(np.r_[starts, len(own)])
            blocks = -(-length // unit)
            first = np.cumsum(blocks) - blocks
            at = np.repeat(starts, blocks) + unit * (np.arange(int(blocks.sum())) - np.repeat(first, blocks))
            text = own[at]
            windows = {}
            for size in sizes:
                span = 2 * size // unit
                index = np.arange(len(at))
                head = (index - np.repeat(first, blocks)) % (size // unit) == 0
                windows[size] = span, index[head]
            for band, s in enumerate(seeds):
                low = np.minimum.reduceat(g * s, at)
                reach, width = low, 1
                for size in sizes:
                    span, head = windows[size]
                    while width < span:
                        joined = reach.copy()
                        if width < len(text):
                            same = text[width:] == text[:-width]
                            joined[:-width] = np.minimum(reach[:-width], np.where(same, reach[width:], _ONES))
                        reach, width = joined, 2 * width
                    keys, items, marked = self.tables[size][band]
                    mine = reach[head]
                    maybe = np.flatnonzero(marked[mine >> np.uint64(48)])
                    a, b = np.searchsorted(keys, mine[maybe], "left"), np.searchsorted(keys, mine[maybe], "right")
                    for w in np.flatnonzero(a < b):
                        t = int(text[head[maybe[w]]])
                        found.update((t, int(k)) for k in items[a[w] : b[w]])
        for count, by_hash in self.short_hash.items():
            keys = np.array(sorted(by_hash), np.uint64)
            g = grams(h, count)
            if not len(g):
                continue
            hit = np.isin(g, keys) & (owner[: len(g)] == owner[count - 1 :])
            for p in np.flatnonzero(hit):
                found.update((int(owner[p]), k) for k in by_hash[int(g[p])])
        return found

    def shared(self, text: bytes, k: int) -> int:
        """How many distinct shingles of item ``k`` occur in the text, compared as strings."""
        shingles = self.items[k][1]
        framed = b" " + b" ".join(text.lower().split()) + b" "
        return sum(b" " + s + b" " in framed for s in shingles)


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", n: int = SHINGLE, containment: float = CONTAINMENT, bands: int = BANDS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``doc_id, item_id, n_shared, n_item, containment`` of every pair at or above ``containment``.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered, shingles ``n`` of them, distinct. An
    item of fewer words is one shingle and is searched for exactly. Items without words
    match nothing, as do null texts. Rows repeat as their inputs do, each on its own whatever
    its id; null ids stay null. Texts may have any length. Other columns are ignored; an
    empty table on either side gives an empty result.
    """
    rows = document_rows(docs, id_col, text_col)
    schema = "doc_id long, item_id long, n_shared int, n_item int, containment double"
    out = None
    for held, last in _blocks(items, item_id_col, item_text_col, block_items):

        def search(batches: Iterable[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = _index(held, n, bands)
            for batch in batches:
                for part, texts in text_groups(batch, "text"):
                    found = list(_search(index, texts, containment))
                    if found:
                        row, item, shared, of = zip(*found, strict=True)
                        columns = [part.column("doc_id").take(pa.array(row)), pa.array(item, pa.int64()), pa.array(shared, pa.int32()), pa.array(of, pa.int32()), pa.array(np.array(shared) / np.array(of))]
                        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "n_shared", "n_item", "containment"])

        found = rows.mapInArrow(search, schema)
        if not (last and out is None):
            found = written(found, "contaminated")
            held.unpersist()
        out = found if out is None else out.unionByName(found)
    return out


_KEPT: dict[tuple, ItemIndex] = {}


def _index(held: Broadcast, n: int, bands: int) -> ItemIndex:
    """The index of a block, built once per worker; the block before is let go."""
    key = (*held.value[0], n, bands)
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = ItemIndex(held.value[1], n, bands)
    return _KEPT[key]


def _blocks(items: DataFrame, id_col: str, text_col: str, block_items: int) -> Iterator[tuple[Broadcast, bool]]:
    """The items, broadcast a block of about ``block_items`` at a time under a name of its own, and whether it is the last."""
    keyed = document_rows(items, id_col, text_col)
    size = keyed.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    passes = max(1, -(-size["n"] // block_items), -(-size["bytes"] // BLOCK_BYTES))
    name = uuid.uuid4().hex
    for block in range(passes):
        mine = keyed.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(passes)) == block) if passes > 1 else keyed
        yield items.sparkSession.sparkContext.broadcast(((name, block), [(r["doc_id"], as_bytes(r["text"])) for r in mine.collect()])), block + 1 == passes


def _search(index: ItemIndex, texts: list[bytes], containment: float) -> Iterator[tuple[int, int, int, int]]:
    """``(text, item id, shared, of)`` of each item that a text contains."""
    lower = [t.lower() for t in texts]
    for t, k in sorted(index.candidates(Words(lower))):
        shared, of = index.shared(lower[t], k), len(index.items[k][1])
        if shared >= containment * of:
            yield t, index.items[k][0], shared, of


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", n: int = SHINGLE, containment: float = CONTAINMENT, bands: int = BANDS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns; edge cases as above."""
    for held, last in _blocks(items, item_id_col, item_text_col, block_items):

        def stays(texts: list[bytes], held=held) -> np.ndarray:
            good = np.ones(len(texts), bool)
            good[[f[0] for f in _search(_index(held, n, bands), texts, containment)]] = False
            return good

        docs = filtered(docs, text_col, stays)
        if not last:
            docs = written(docs, "decontaminated")
            held.unpersist()
    return docs
