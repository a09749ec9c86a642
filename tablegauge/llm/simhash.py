"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint is cut into segments. If two fingerprints differ in at most
``distance`` bits, then in some segment they differ in at most its radius, where the
radii are dealt so that their sum plus the number of segments exceeds the distance.
Each segment has a table keyed by its value; every fingerprint probes it with its own
value and the small Hamming ball around it, and complete distances are verified.

Only distinct fingerprints take part, so copies cost nothing, and a fingerprint has a
bounded number of neighbours whatever the corpus: sum of C(64, i) for i up to the distance.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt_join, document_rows, with_computed, with_frequent_apart, written
from .components import connected_components

DISTANCE = 3
SHINGLE = 3


def fingerprint(text: bytes, n: int = SHINGLE) -> int:
    """Majority of the bits of XXH64 (seed 42) over the shingles of ``n`` words, A-Z lowered.

    Words are ``[^\\x20\\x09-\\x0D]+``; fewer than ``n`` make one shingle; none give zero.
    A bit is one if set in over half of the hashes.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= n:
        spans = [joined]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.r_[0, ends[:-n]].tolist()
        spans = [joined[a:b] for a, b in zip(starts, (ends[n - 1 :] - 1).tolist(), strict=True)]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, 42) for s in spans], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 8192):
        ones += np.unpackbits(h[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` (a signed long of the same bits) for every row; null text is empty."""
    return with_computed(document_rows(docs, id_col, text_col), lambda texts: {"fp": np.array([fingerprint(t, n) for t in texts], np.uint64).view(np.int64)}, "fp long")


def segments(distance: int, tables: int = 2) -> list[tuple[int, int, int]]:
    """``(shift, bits, radius)`` of each segment: widths and radii dealt evenly."""
    total = distance + 1 - tables  # the radii's sum that the pigeonhole needs
    radii = [max(0, total // tables + (k < total % tables)) for k in range(tables)] if total > 0 else [0] * tables
    widths = [64 // tables + (k < 64 % tables) for k in range(tables)]
    shifts = [sum(widths[:k]) for k in range(tables)]
    return list(zip(shifts, widths, radii, strict=True))


def links(fps: DataFrame, distance: int = DISTANCE, tables: int = 2) -> DataFrame:
    """Pairs ``a < b`` of distinct values of ``fps(fp)`` that differ in at most ``distance`` bits.

    A pair found in several tables is returned once for each.
    """
    index, probe = [], []
    for k, (shift, bits, radius) in enumerate(segments(distance, tables)):
        value = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << bits) - 1))
        masks = [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(bits), r)]
        index.append(fps.select(F.lit(k).alias("t"), value.alias("v"), "fp"))
        ball = fps.select(F.lit(k).alias("t"), value.alias("v0"), "fp", F.explode(F.lit(np.array(masks, np.int64))).alias("mask"))
        # of two values that differ by a mask, only the one without the mask's lowest bit probes
        lowest = F.col("mask").bitwiseAND(-F.col("mask"))
        probe.append(ball.where(F.col("v0").bitwiseAND(lowest) == 0).select("t", F.col("v0").bitwiseXOR(F.col("mask")).alias("v"), F.col("fp").alias("other"), "mask"))
    left, right = index[0], probe[0]
    for x, y in zip(index[1:], probe[1:], strict=True):
        left, right = left.unionByName(x), right.unionByName(y)
    met = dealt_join(right, left, ["t", "v"]).where((F.col("mask") != 0) | (F.col("fp") < F.col("other")))
    near = met.where((F.col("fp") != F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= distance))
    return near.select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b"))


def classes(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``fp, component_id, copies`` of each distinct fingerprint of ``fps(doc_id, fp)``, whose ids are not null.

    ``component_id`` is the smallest id that links reach, ``copies`` the fingerprint's rows.
    """
    groups = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "fingerprint-groups")
    # components run on each fingerprint's smallest document, which orders them as the result asks
    pairs = links(groups.select("fp"), distance).distinct()
    x = groups.select(F.col("fp").alias("a"), F.col("least").alias("la"))
    y = groups.select(F.col("fp").alias("b"), F.col("least").alias("lb"))
    edges = dealt_join(dealt_join(pairs, x, "a"), y, "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    reached = connected_components(edges)
    return written(dealt_join(groups, reached.withColumnRenamed("node", "least"), "least", "left").select("fp", F.coalesce("component", "least").alias("component_id"), "copies"), "fingerprint-components")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    ``fingerprint`` is 16 lowercase hex digits; ``component_id`` the smallest id that
    links reach, itself included. Null and empty texts have fingerprint zero and are
    linked like any other. Rows are returned as often as they occur, those of one id with
    different texts each with its own fingerprint; they belong together where a component
    is found by that id. Rows with a null id have a fingerprint and no component, and link
    nothing. Texts may have any length. Other columns are ignored, an empty table gives an
    empty one.
    """
    all_rows = written(fingerprints(docs, id_col, text_col, n), "fingerprints")
    rows = all_rows.where("doc_id is not null")
    found = with_frequent_apart(rows, classes(rows, distance), "fp", "copies", deal=True).unionByName(all_rows.where("doc_id is null"), allowMissingColumns=True)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
