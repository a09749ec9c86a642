"""Documents whose five-word shingles agree, by SimHash classes, MinHash bands and exact verification.

Texts meet in the classes of operator 6: SimHash fingerprints within three bits, found by
multi-index hashing, and what such links reach. Similar texts with fingerprints further
apart meet in MinHash bands: at a Jaccard similarity of ``s`` of their shingle sets, in
one of ``BANDS`` bands of ``ROWS`` minima each with a probability of
``1 - (1 - s ** ROWS) ** BANDS``, 0.99993 at 0.8. A class is a bucket as a band's value
is; texts that meet in either are compared by their whole sets.

Only distinct sets take part. Each first meets the one of its bucket that meets the most
others in its own, the middle of a group of copies, which joins most of a large group.
Texts of buckets that are not of one component then meet by their rarest shingles: of two sets that are similar enough, the rarest few of each
must share one, so far from the end that what follows can still be enough. That misses no
pair, and texts that only share frequent passages do not meet at all.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, dealt_join, document_rows, grams, mix, unwritten, with_computed, with_frequent_apart, written
from .components import connected_components
from .simhash import classes, fingerprint

SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 24, 5
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def shingles(text: bytes, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``n`` words, A-Z lowered; fewer words make one, none none."""
    h = Words([text.lower()]).hash
    return np.unique(grams(h, min(n, len(h)))) if len(h) else np.zeros(0, np.uint64)


def _content(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes(), 42)


def _bands(s: np.ndarray) -> np.ndarray:
    """One hash for each band, none for an empty set."""
    if not len(s):
        return np.zeros(0, np.int64)
    minima = np.array([(s * seed).min() for seed in _SEEDS], np.uint64).reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + minima[:, j])
    return key.view(np.int64)


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def signatures(rows: DataFrame) -> DataFrame:
    """``doc_id, tx, content, size, bands, fp`` of ``rows(doc_id, text)``: a hash of the text, one of its set, the set's size, its bands, the text's fingerprint."""

    def compute(texts: list[bytes]) -> dict:
        sets = [shingles(t) for t in texts]
        return {"content": _signed([_content(s) for s in sets]), "size": [len(s) for s in sets], "bands": [_bands(s) for s in sets], "fp": _signed([fingerprint(t) for t in texts])}

    return with_computed(rows.withColumn("tx", F.xxhash64("text")), compute, "content long, size int, bands array<long>, fp long")


def _classed(signed: DataFrame) -> DataFrame:
    """``content, size, key`` of the sets of ``signed``: the classes of operator 6 that a set's texts belong to."""
    named = classes(signed.select("doc_id", "fp")).select("fp", F.xxhash64("component_id").alias("key"))
    return dealt_join(signed.where("size > 0").select("content", "size", "fp").distinct(), named, "fp").select("content", "size", "key").distinct()


def _texts(contents: DataFrame, rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``content, packed``: a compressed text of each of some sets."""

    def pack(texts: list[bytes]) -> dict:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        return {"content": _signed([_content(shingles(t)) for t in texts]), "packed": [squeeze(t) for t in texts]}

    ids = dealt_join(groups, contents, "content", "left_semi").select(F.col("least").alias("doc_id")).distinct()
    # a few rows may share an id, or an id and a text: only one of each set is kept
    found = with_computed(dealt_join(rows, ids, "doc_id", "left_semi"), pack, "content long, packed binary").drop("doc_id").dropDuplicates(["content"])
    return written(dealt_join(found, contents, "content", "left_semi"), "near-copy-texts")


def _verified(pairs: DataFrame, rows: DataFrame, groups: DataFrame, similarity: float) -> DataFrame:
    """The ``a, b`` of ``pairs(a, b)`` whose sets are that similar; texts are read again for them alone."""

    def similar(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        held: dict[int, np.ndarray] = {}

        def known(content: int, packed: pa.Scalar) -> np.ndarray:
            if content not in held:
                if len(held) >= 32:
                    held.clear()
                held[content] = shingles(unpack(packed.as_py()))
            return held[content]

        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for k, (a, b) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)):
                x, y = known(a, batch.column("x")[k]), known(b, batch.column("y")[k])
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[k] = both >= similarity * (len(x) + len(y) - both)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    asked = pairs.select(F.col("a").alias("content")).unionByName(pairs.select(F.col("b").alias("content"))).distinct()
    texts = _texts(asked, rows, groups)
    met = dealt_join(pairs, texts.select(F.col("content").alias("a"), F.col("packed").alias("x")), "a")
    met = dealt_join(met, texts.select(F.col("content").alias("b"), F.col("packed").alias("y")), "b")
    out = written(met.sortWithinPartitions("b").mapInArrow(similar, "a long, b long"), "near-copy-links")
    unwritten(texts)
    return out


def _rarest_met(torn: DataFrame, rows: DataFrame, groups: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``a > b`` of ``torn(content, c)`` of different ``c`` that may be similar enough.

    A set's shingles are ordered by how many of these sets have them. Sets of ``n`` and
    ``m`` shingles need ``least(n, m) = similarity / (1 + similarity) * (n + m)`` in common;
    a shingle takes part for partners of a size only if as many come from it on. Sizes are
    dealt to bins of a twentieth, and a shingle is keyed by both bins of a pair.
    """

    def spread(texts: list[bytes]) -> dict:
        sets = [shingles(t) for t in map(zstandard.ZstdDecompressor().decompress, texts)]
        return {"n": [len(s) for s in sets], "s": [s.view(np.int64) for s in sets]}

    packed = _texts(torn.select("content"), rows, groups)
    sets = with_computed(packed, spread, "n int, s array<long>", "packed")
    tokens = written(sets.select("content", "n", F.explode("s").alias("s")), "near-copy-shingles")
    often = tokens.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")  # one that no other set has joins nothing, but comes first
    ranked = dealt_join(tokens, often, "s", "left").groupBy("content", "n").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "s"))).alias("t"))
    binned = lambda n: F.floor(F.log(n) / float(np.log(1.05)) + 1e-9).cast("int")
    share = similarity / (1 + similarity)
    # the most places from the front that any partner's size allows
    front = F.col("n") - F.ceil(similarity * F.col("n") - 1e-9) + 1
    first = ranked.select("content", "n", F.posexplode(F.slice("t", 1, front.cast("int"))).alias("at", "t")).where("t.df > 1")
    bins = F.explode(F.sequence(binned(F.greatest(F.lit(1.0), F.ceil(similarity * F.col("n") - 1e-9))), binned(F.floor(F.col("n") / similarity + 1e-9))))
    placed = first.select("content", "n", "at", F.col("t.s").alias("s"), binned(F.col("n")).alias("own"), bins.alias("other"))
    smallest = F.greatest(F.ceil(F.exp(F.col("other") * float(np.log(1.05))) - 1e-6), F.ceil(similarity * F.col("n") - 1e-9))
    placed = placed.where(F.col("n") - F.col("at") >= share * (F.col("n") + smallest) - 1e-6)
    keyed = written(dealt_join(placed, torn, "content").select("s", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "content", "n", "at", "c").distinct(), "near-copy-rarest")
    x = keyed.select("s", "low", "high", F.col("own").alias("p_own"), F.col("content").alias("a"), F.col("n").alias("p"), F.col("at").alias("p_at"), F.col("c").alias("ca"))
    y = keyed.select("s", "low", "high", F.col("own").alias("q_own"), F.col("content").alias("b"), F.col("n").alias("q"), F.col("at").alias("q_at"), F.col("c").alias("cb"))
    enough = F.least(F.col("p") - F.col("p_at"), F.col("q") - F.col("q_at")) >= share * (F.col("p") + F.col("q")) - 1e-6
    sized = F.col("p_own") + F.col("q_own") == F.col("low") + F.col("high")
    met = dealt_join(x, y, ["s", "low", "high"]).where((F.col("a") > F.col("b")) & (F.col("ca") != F.col("cb")) & sized & enough)
    return met.select("a", "b").distinct()


def _grouped(rows: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The sets of ``rows(doc_id, text)``, and what each belongs to.

    First ``doc_id, tx, content`` of each row; then for each set ``content, copies``, its
    ``component`` (a set's hash) and the ``doc_id, tx, n`` of the component's first document:
    the least id, among its texts the least hash, in ``n`` rows.
    """
    signed = written(signatures(rows), "near-copy-bands")
    places = signed.groupBy("content", "doc_id", "tx").agg(F.count("*").alias("n"))
    groups = written(places.groupBy("content").agg(F.min(F.struct("doc_id", "tx", "n")).alias("head"), F.min("doc_id").alias("least"), F.sum("n").alias("copies")), "near-copy-groups")
    one = signed.dropDuplicates(["content"]).select("content", "size", F.explode("bands").alias("key")).unionByName(_classed(signed))
    full = written(dealt_join(one, one.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key"), "near-copy-met")
    # the middle of a group of copies meets the most others; each bucket's is compared with all of it
    middle = full.groupBy("content").agg(F.sum("n").alias("meets"))
    met = dealt_join(full, middle, "content").select("key", F.struct("meets", "content", "size").alias("m"))
    buckets = dealt_join(met, met.groupBy("key").agg(F.max("m").alias("most")), "key")
    buckets = written(buckets.select("key", "m.content", "m.size", F.col("most.content").alias("b"), F.col("most.size").alias("b_size")), "near-copy-buckets")
    unwritten(full)
    alike = F.least("size", "b_size") >= similarity * F.greatest("size", "b_size")  # sizes that allow the similarity
    stars = buckets.where((F.col("content") != F.col("b")) & alike).select(F.greatest("content", "b").alias("a"), F.least("content", "b").alias("b")).distinct()
    stars = written(stars, "near-copy-pairs")
    links = _verified(stars, rows, groups, similarity)
    reached = connected_components(links)
    named = dealt_join(buckets, reached.withColumnRenamed("node", "content"), "content", "left").select("key", "content", "size", F.coalesce("component", "content").alias("c"))
    # buckets of two sets have compared them
    torn = named.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("n")).where("low <> high and n > 2").select("key")
    torn = written(dealt_join(named, torn, "key", "left_semi").select("content", "c").distinct(), "near-copy-torn")
    unwritten(buckets)
    if torn.limit(1).count():
        rest = written(dealt_join(_rarest_met(torn, rows, groups, similarity), stars, ["a", "b"], "left_anti"), "near-copy-pairs")
        more = _verified(rest, rows, groups, similarity)
        reached = connected_components(links.unionByName(more))
    named = dealt_join(groups, reached.withColumnRenamed("node", "content"), "content", "left").withColumn("component", F.coalesce("component", "content"))
    heads = named.groupBy("component").agg(F.min("head").alias("first"), F.count("*").alias("sets"))
    found = with_frequent_apart(named.select("content", "component", "copies"), heads, "component", "sets", deal=True)
    return signed.select("doc_id", "tx", "content"), written(found.select("content", "component", "copies", "first.*"), "near-copy-components")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, component_id`` of every row; ``component_id`` is the smallest id that links reach.

    Null and texts without words have an empty set and are copies of each other. Rows are
    returned as often as they occur, those of one id with different texts each with what
    its own text belongs to. Rows with a null id link nothing and have no component. Texts
    may have any length, other columns are ignored, an empty table gives an empty one.
    """
    rows = document_rows(docs, id_col, text_col)
    unnamed = rows.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("component_id"))
    signed, found = _grouped(rows.where("doc_id is not null"), similarity)
    final = found.select("content", F.col("doc_id").alias("component_id"), "copies")
    return with_frequent_apart(signed.select("doc_id", "content"), final, "content", "copies", deal=True).select("doc_id", "component_id").unionByName(unnamed)


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row of ``docs`` for each group of near copies, in the columns of ``docs``.

    It is the row of the smallest id; among texts of one id that are of the same group, that
    of the smallest hash; of rows that repeat an id and a text, any one. Rows that share an
    id but not their group each stand for their own. Rows with a null id all stay. Null,
    empty and wordless texts are one group. An empty table gives an empty one; columns may
    have any names.
    """
    signed, found = _grouped(document_rows(docs, id_col, text_col).where(F.col("doc_id").isNotNull()), similarity)
    ours = [f"__{'_' * max(map(len, docs.columns))}{c}" for c in ("doc_id", "tx", "n")]
    firsts = found.select("doc_id", "tx", "n").distinct().toDF(*ours)
    text = docs[text_col].cast("string").cast("binary")

    def of(some: DataFrame) -> DataFrame:
        return dealt_join(docs, some, (docs[id_col].cast("long") == some[ours[0]]) & (F.xxhash64(text) == some[ours[1]]))

    firsts = written(firsts, "near-copy-firsts")
    again = firsts.where(F.col(ours[2]) > 1)
    out = of(firsts.where(F.col(ours[2]) == 1)).select(*[docs[c] for c in docs.columns])
    if again.limit(1).count():
        out = out.unionByName(of(again).dropDuplicates(ours[:2]).select(*[docs[c] for c in docs.columns]))
    return out.unionByName(docs.where(docs[id_col].cast("long").isNull()))
