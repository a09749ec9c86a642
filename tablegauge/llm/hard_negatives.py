"""Hard negatives by inner product, searched in STR-packed R-trees.

Rows are dealt to tiles by sort-tile-recursive cuts, and a tile's rows are packed into an
R-tree the same way: leaves of ``LEAF`` rows, nodes of ``FAN`` children, each with the
least and greatest value of every coordinate and of the labels below it. From a box and an
anchor each coordinate's product lies in an interval; their sum bounds every score below.

A search takes an anchor's wanted score windows through a best-first queue of nodes. A box
is left out if for every window its scores lie outside, or strictly below the k-th score
found. First each anchor is searched in its own tile, which gives it a k-th score; anchors
in blocks then meet the boxes of all tiles, and those tiles that may still hold something.
Every row is in the index and nothing is skipped, so results are exact.

Components are integers; scores are exact 64-bit inner products.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Rows of a tile, of a leaf; children of a node.
TILE, LEAF, FAN = 4096, 64, 8
#: Rows that the tiles' cuts are taken from, about; all rows are indexed.
SAMPLE = 1 << 16
#: Tiles whose boxes are asked together; tiles whose anchors make a block; blocks that meet a tile in one task.
BOXES, BLOCK_TILES, BLOCKS = 64, 25, 8
#: Axes that rows are tiled along.
AXES = 3
#: Components beyond this size are out of range.
LARGEST = 1 << 25
_ANY = 1 << 62


def _saved(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _loaded(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as got:
        return {c: got[c] for c in got.files}


def str_order(points: np.ndarray, leaf: int = LEAF, axes: int = AXES) -> np.ndarray:
    """Rows in the order of sort-tile-recursive packing along the widest axes; ties keep their order."""
    axis = np.argsort(-points.var(axis=0), kind="stable")[:axes]

    def tiled(rows: np.ndarray, k: int) -> np.ndarray:
        rows = rows[np.argsort(points[rows, axis[k]], kind="stable")]
        left = len(axis) - k
        if left == 1 or len(rows) <= leaf:
            return rows
        slabs = int(np.ceil((len(rows) / leaf) ** (1 / left)))
        size = leaf * -(-len(rows) // (leaf * slabs))
        return np.concatenate([tiled(rows[a : a + size], k + 1) for a in range(0, len(rows), size)])

    return tiled(np.arange(len(points)), 0) if len(axis) else np.arange(len(points))


class Cuts:
    """Sort-tile-recursive cuts of a sample along two axes, by which any row finds its tile."""

    def __init__(self, sample: np.ndarray, tiles: int):
        self.axis = np.argsort(-sample.var(axis=0), kind="stable")[:2] if len(sample) else np.zeros(0, np.int64)
        slabs = max(1, round(tiles**0.5)) if len(self.axis) > 1 else tiles
        self.outer = self._cut(sample[:, self.axis[0]], slabs) if len(self.axis) else np.zeros(0)
        self.inner = []
        if len(self.axis) > 1:
            own = np.searchsorted(self.outer, sample[:, self.axis[0]], "right")
            self.inner = [self._cut(sample[own == k, self.axis[1]], -(-tiles // slabs)) for k in range(len(self.outer) + 1)]
        self.first = np.cumsum([0] + [len(c) + 1 for c in self.inner])

    @staticmethod
    def _cut(values: np.ndarray, parts: int) -> np.ndarray:
        return np.unique(np.quantile(values, np.arange(1, parts) / parts)) if parts > 1 and len(values) else np.zeros(0)

    def of(self, points: np.ndarray) -> np.ndarray:
        """The tile of each row."""
        if not len(self.axis):
            return np.zeros(len(points), np.int64)
        slab = np.searchsorted(self.outer, points[:, self.axis[0]], "right")
        if not self.inner:
            return slab
        out = np.zeros(len(points), np.int64)
        for k in np.unique(slab):
            mine = slab == k
            out[mine] = self.first[k] + np.searchsorted(self.inner[k], points[mine, self.axis[1]], "right")
        return out


class Tree:
    """A packed R-tree over rows in the order of their leaves."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, points: np.ndarray):
        self.ids, self.labels, self.exact = ids, labels, points.astype(np.int64)
        self.points = points.astype(np.float64)
        self.largest = int(np.abs(self.exact).max(initial=0))
        at = np.arange(0, len(ids), LEAF)
        level = [f.reduceat(x, at) for x in (self.exact, labels) for f in (np.minimum, np.maximum)]
        self.levels = [level]
        while len(level[0]) > 1:
            at = np.arange(0, len(level[0]), FAN)
            level = [f.reduceat(x, at) for f, x in zip((np.minimum, np.maximum) * 2, level, strict=True)]
            self.levels.append(level)
        self.levels = [(low.astype(float), high.astype(float), a, b) for low, high, a, b in self.levels]

    def scores(self, a: int, b: int, query: np.ndarray) -> np.ndarray:
        """Inner products of rows ``a`` to ``b``: in floats where those are exact."""
        if self.largest * float(np.abs(query).max(initial=0)) * len(query) < 2**53:
            return (self.points[a:b] @ query).astype(np.int64)
        return self.exact[a:b] @ query.astype(np.int64)

    def search(self, query: np.ndarray, anchor: int, label: int, same: bool, low: np.ndarray, high: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
        """For each window the first ``k`` of ``(-score, id)`` among rows of the same, or of other labels, but the anchor.

        ``low`` also holds what the k-th score found elsewhere is; it is raised in place.
        """
        found: list[list[tuple[int, int]]] = [[] for _ in low]
        up, down = np.maximum(query, 0).astype(float), np.minimum(query, 0).astype(float)
        room = 1e-9 * float(np.abs(query).sum()) * max(1, self.largest)  # of rounding, where floats are not exact
        top = len(self.levels) - 1
        queue: list[tuple[float, int, int, float]] = []

        def enter(level: int, first: int, last: int) -> None:
            lows, highs, least, most = self.levels[level]
            lows, highs, least, most = lows[first:last], highs[first:last], least[first:last], most[first:last]
            upper, lower = highs @ up + lows @ down + room, lows @ up + highs @ down - room
            fits = (least <= label) & (label <= most) if same else (least != label) | (most != label)
            fits &= ((upper[:, None] >= low) & (lower[:, None] <= high)).any(axis=1)
            for i in np.flatnonzero(fits).tolist():
                heapq.heappush(queue, (-float(upper[i]), level, first + i, float(lower[i])))

        enter(top, 0, len(self.levels[top][0]))
        while queue:
            upper, level, node, lower = heapq.heappop(queue)
            if -upper < low.min():
                break  # all that is left is strictly below every window's k-th
            if not ((-upper >= low) & (lower <= high)).any():
                continue
            if level:
                enter(level - 1, node * FAN, min((node + 1) * FAN, len(self.levels[level - 1][0])))
                continue
            a, b = node * LEAF, min((node + 1) * LEAF, len(self.ids))
            score = self.scores(a, b, query)
            at = np.flatnonzero(((self.labels[a:b] == label) == same) & (self.ids[a:b] != anchor) & (score >= low.min()))
            if not len(at):
                continue
            score, ids = score[at], self.ids[a:b][at]
            for j in range(len(low)):
                inside = (score >= low[j]) & (score <= high[j])
                if inside.any():
                    best = sorted(found[j] + list(zip((-score[inside]).tolist(), ids[inside].tolist(), strict=True)))[:k]
                    found[j] = best
                    if len(best) == k:
                        low[j] = max(low[j], -best[-1][0])
        return found


def integer_vectors(table: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """``vec_id, label, v``: components ``floor(scale * x)`` as little-endian 32-bit integers, all of one length.

    Left out are rows with a null id, label or vector, with a component that is null or not
    finite, or beyond ``LARGEST`` once scaled. Shorter vectors end in zeros. Of rows that
    repeat an id, the one of the smallest label, then vector, counts.
    """
    x = F.col(vector_col).cast("array<double>")
    sound = lambda c: F.coalesce(F.abs(c * scale) < LARGEST, F.lit(False)) & ~F.isnan(c)
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), x.alias("x")).where("vec_id is not null and label is not null and x is not null")
    rows = rows.where(F.forall("x", sound)).select("vec_id", "label", F.transform("x", lambda c: F.floor(c * scale).cast("int")).alias("v"))
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.*")
    rows = written(rows, "vectors")
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for v in batch.column("v").to_pylist():
                row = np.zeros(width, "<i4")
                row[: len(v)] = v
                made.append(row.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(made, pa.binary())], ["vec_id", "label", "v"])

    return rows.mapInArrow(pack, "vec_id long, label long, v binary")


def _points(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), "<i4").reshape(len(values), -1) if values and len(values[0]) else np.zeros((len(values), 0), "<i4")


class Index:
    """Tiles of all rows, each a packed tree, and the boxes of the tiles."""

    def __init__(self, vectors: DataFrame, tile: int = TILE, sample: int = SAMPLE):
        vectors = written(vectors, "vectors-packed")
        n = vectors.count()
        share = max(1, n // sample)
        some = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(share)) == 0).orderBy("vec_id").select("v").limit(2 * sample).toArrow()
        cuts = Cuts(_points(some.column("v")), max(1, min(-(-n // tile), some.num_rows // 16)))

        def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cuts.of(_points(batch.column("v"))), pa.int64())], ["vec_id", "label", "v", "part"])

        dealt = written(vectors.mapInArrow(deal, "vec_id long, label long, v binary, part long"), "vectors-dealt")
        # rows that no cut tells apart are too many for one tile: those are split by their ids
        counts = dict(sorted(map(tuple, dealt.groupBy("part").count().collect())))  # at most a row for 16 of the sample
        many = [-(-c // tile) for c in counts.values()]
        places = list(zip(counts, np.cumsum([0, *many])[:-1].tolist(), many, strict=True))
        few = dealt.sparkSession.createDataFrame(places, "part long, first long, many long")
        tiled = dealt.join(F.broadcast(few), "part").select((F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("many"))).alias("tile"), "vec_id", "label", "v")

        def build(group: pa.Table) -> pa.Table:
            group = group.sort_by("vec_id")
            points = _points(group.column("v"))
            order = str_order(points)
            ids, labels, points = group.column("vec_id").to_numpy()[order], group.column("label").to_numpy()[order], points[order]
            box = _saved(low=points.min(axis=0), high=points.max(axis=0), labels=np.array([labels.min(), labels.max()]))
            return pa.table({"tile": pa.array([group.column("tile")[0].as_py()], pa.int64()), "box": pa.array([box], pa.binary()), "tree": pa.array([_saved(ids=ids, labels=labels, points=points)], pa.binary())})

        self.tiles = int(sum(many))
        self.rows = tiled
        self.trees = written(tiled.groupBy("tile").applyInArrow(build, "tile long, box binary, tree binary"), "trees")

    def best(self, asked: DataFrame, k: int, same: bool) -> DataFrame:
        """``anchor_id, slot, rank, score, other_id``: the first ``k`` of each window, by score, then the smaller id.

        ``asked(tile, anchor_id, label, v, low, high)``: anchors in their own tile with arrays
        of windows, inclusive; ``slot`` counts them from 0. An anchor is asked in one row.
        """

        def home(asked: pa.Table, trees: pa.Table) -> pa.Table:
            got = Tree(**_loaded(trees.column("tree")[0].as_py())) if trees.num_rows and asked.num_rows else None
            lows, found = [], []
            for row in zip(*(asked.column(c).to_pylist() for c in ("anchor_id", "label", "v", "low", "high")), strict=True):
                low = np.array(row[3], np.int64)
                best = got.search(np.frombuffer(row[2], "<i4"), row[0], row[1], same, low, np.array(row[4], np.int64), k)
                lows.append(low.tolist())
                found.append([{"slot": j, "score": -s, "other_id": i} for j, b in enumerate(best) for s, i in b])
            out = {c: asked.column(c) for c in ("tile", "anchor_id", "label", "v")}
            return pa.table(out | {"low": pa.array(lows, pa.list_(pa.int64())), "high": pa.array(asked.column("high").to_pylist(), pa.list_(pa.int64())), "found": pa.array(found, pa.list_(pa.struct([("slot", pa.int32()), ("score", pa.int64()), ("other_id", pa.int64())])))})

        trees = self.trees.select("tile", "tree")
        kept = "tile long, anchor_id long, label long, v binary, low array<long>, high array<long>"
        first = written(asked.groupBy("tile").cogroup(trees.groupBy("tile")).applyInArrow(home, kept + ", found array<struct<slot: int, score: long, other_id: long>>"), "negatives-home")
        rows = first.select("anchor_id", F.explode("found").alias("f")).select("anchor_id", "f.*")
        if self.tiles > 1:
            rows = rows.unionByName(self._elsewhere(first, k, same))
        order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "other_id")
        return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("anchor_id", "slot", "rank", "score", "other_id")

    def _elsewhere(self, first: DataFrame, k: int, same: bool) -> DataFrame:
        """What the tiles other than their own add to anchors that were searched at home."""

        def pack(group: pa.Table) -> pa.Table:
            wide = max((len(x) for x in group.column("low").to_pylist()), default=0)
            low, high = np.full((group.num_rows, wide), 1, np.int64), np.zeros((group.num_rows, wide), np.int64)  # empty windows
            for name, out in (("low", low), ("high", high)):
                for i, x in enumerate(group.column(name).to_pylist()):
                    out[i, : len(x)] = x
            numbers = {c: group.column(c).to_numpy() for c in ("anchor_id", "label", "tile")}
            data = _saved(points=_points(group.column("v")), low=low, high=high, **numbers)
            return pa.table({"block": pa.array([group.column("block")[0].as_py()], pa.int64()), "asked": pa.array([data], pa.binary())})

        def shelve(group: pa.Table) -> pa.Table:
            group = group.sort_by("tile")
            boxes = [_loaded(b) for b in group.column("box").to_pylist()]
            data = _saved(tile=group.column("tile").to_numpy(), **{c: np.stack([b[c] for b in boxes]) for c in ("low", "high", "labels")})
            return pa.table({"shelf": pa.array([group.column("shelf")[0].as_py()], pa.int64()), "boxes": pa.array([data], pa.binary())})

        def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, asked, boxes in zip(*(batch.column(c).to_pylist() for c in ("block", "asked", "boxes")), strict=True):
                    a, b = _loaded(asked), _loaded(boxes)
                    up, down = np.maximum(a["points"], 0).astype(float), np.minimum(a["points"], 0).astype(float)
                    low, high = b["low"].astype(float).T, b["high"].astype(float).T
                    upper, lower = up @ high + down @ low, up @ low + down @ high
                    room = 1e-9 * (np.abs(upper) + np.abs(lower) + 1)
                    label, labels = a["label"][:, None], b["labels"].T
                    fits = (labels[0] <= label) & (label <= labels[1]) if same else (labels[0] != label) | (labels[1] != label)
                    wanted = np.zeros(fits.shape, bool)
                    for j in range(a["low"].shape[1]):
                        wanted |= (upper + room >= a["low"][:, j : j + 1]) & (lower - room <= a["high"][:, j : j + 1]) & (a["low"] <= a["high"])[:, j : j + 1]
                    fits &= wanted & (a["tile"][:, None] != b["tile"][None])
                    for t in np.flatnonzero(fits.any(axis=0)).tolist():
                        part = _saved(**{c: v[fits[:, t]] for c, v in a.items()})
                        yield pa.RecordBatch.from_arrays([pa.array([int(b["tile"][t])]), pa.array([block // BLOCKS]), pa.array([part], pa.binary())], ["tile", "salt", "asked"])

        def search(asked: pa.Table, trees: pa.Table) -> pa.Table:
            out: list[tuple[int, int, int, int]] = []
            got = Tree(**_loaded(trees.column("tree")[0].as_py())) if trees.num_rows and asked.num_rows else None
            for data in asked.column("asked").to_pylist():
                a = _loaded(data)
                for i in range(len(a["anchor_id"])):
                    best = got.search(a["points"][i], int(a["anchor_id"][i]), int(a["label"][i]), same, a["low"][i], a["high"][i], k)
                    out += [(int(a["anchor_id"][i]), j, -s, o) for j, b in enumerate(best) for s, o in b]
            columns = list(zip(*out, strict=True)) or [[]] * 4
            return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["anchor_id", "slot", "score", "other_id"])

        blocks = first.drop("found").withColumn("block", F.floor(F.col("tile") / BLOCK_TILES)).groupBy("block").applyInArrow(pack, "block long, asked binary")
        shelves = self.trees.select("tile", "box").withColumn("shelf", F.floor(F.col("tile") / BOXES)).groupBy("shelf").applyInArrow(shelve, "shelf long, boxes binary")
        upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n).cast("long")))
        met = blocks.withColumn("shelf", upto((self.tiles - 1) // BOXES))
        routed = written(met.join(shelves, "shelf").mapInArrow(route, "tile long, salt long, asked binary"), "negatives-routed")
        salts = (self.tiles - 1) // BLOCK_TILES // BLOCKS
        trees = self.trees.select("tile", "tree").withColumn("salt", upto(salts))
        return routed.groupBy("tile", "salt").cogroup(trees.groupBy("tile", "salt")).applyInArrow(search, "anchor_id long, slot int, score long, other_id long")


def mined(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, tile: int = TILE, sample: int = SAMPLE) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the anchors among ``vectors(vec_id, label, v)``.

    Anchors are the rows whose id ``every`` divides. An anchor's positives are the first
    ``positives`` other rows of its label, by inner product, ties by the smaller id. A negative
    of a positive is a row of another label with ``least * p <= 100 * n <= most * p`` for the
    positive's score ``p`` and its own ``n``; the first ``negatives`` are returned, ranked from 1. A
    positive of a score below zero has none. Anchors without positives, and positives without
    negatives, have no rows. Rows are those of ``integer_vectors``: each id once, all of one
    length. An empty table gives an empty result.
    """
    index = Index(vectors, tile, sample)
    anchors = index.rows.where(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "anchor_id")
    everything = [F.array(F.lit(x).cast("long")).alias(c) for c, x in (("low", -_ANY), ("high", _ANY))]
    near = written(index.best(anchors.select("tile", "anchor_id", "label", "v", *everything), positives, True), "positives")
    window = F.struct("rank", F.expr(f"({least} * score + 99 - pmod({least} * score + 99, 100)) div 100").alias("low"), F.expr(f"({most} * score - pmod({most} * score, 100)) div 100").alias("high"))
    windows = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(window)).alias("w"))  # of at most ``positives``
    asked = anchors.join(windows, "anchor_id").select("tile", "anchor_id", "label", "v", F.col("w.low").alias("low"), F.col("w.high").alias("high"))
    found = index.best(asked, negatives, False)
    named = near.select("anchor_id", (F.col("rank") - 1).alias("slot"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(named, ["anchor_id", "slot"]).select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
