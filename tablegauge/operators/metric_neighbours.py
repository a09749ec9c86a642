"""Exact nearest neighbours of every row, by cells around pivots and the triangle inequality.

Rows that share a vector are searched once. Distinct vectors are dealt to the nearest of
some pivots and, within that cell, to rings by their distance to it: blocks of about
``BLOCK`` vectors. In its own block a row finds a bound on its k-th distance. A block can
hold something nearer only if the row's distance to that block's pivot, less the bound,
reaches into its ring; blocks that no row of another reaches never meet it. A block's rows
then take the blocks they reach as a stream, nearest first, and keep their ``k`` best, so no
list grows beyond that. Blocks whose rows reach most others are asked together, so that the
stream is sent once for many of them. Whatever the bounds, the result is that of all pairs:
on vectors without any structure, where nothing can be left out, all pairs are what is
measured. Where neighbours of a few rows alone are asked for, those rows are sent to all others.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.stored import discarded, stored

#: Vectors of a block, and the most pivots.
BLOCK, PIVOTS = 1024, 1024
#: Blocks that one task streams past another.
STRIPE = 1024
#: Blocks that reach most others and are asked together at most, groups of them that are wanted, and neighbours that one group keeps.
JOINED, GROUPS, KEPT = 16, 64, 1 << 22
#: Rows and columns of distances that are looked at together.
ROWS, COLUMNS = 1024, 512
#: Asked rows that are sent to all others together, and passes of them; more are searched in blocks.
FEW, PASSES = 4096, 4
#: Relative room for rounding in distances that only bound.
ROOM = 1e-9


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _keys(column: pa.Array) -> np.ndarray:
    """Keys as integers where they are, else as objects."""
    if pa.types.is_integer(column.type):
        return column.to_numpy()
    out = np.empty(len(column), object)
    out[:] = column.to_pylist()
    return out


def _labels(column: pa.Array) -> np.ndarray:
    """Labels as integers where they are and none is null, else as objects."""
    if pa.types.is_integer(column.type) and not column.null_count:
        return column.to_numpy()
    out = np.empty(len(column), object)
    out[:] = column.to_pylist()
    return out


class Metric:
    """Euclidean distance of numbers; of mixed vectors, unequal codes add to the square.

    A mixed vector is its numbers, then ``codes`` numbers that name categories, then what each
    unequal category adds to the squared distance, which is the same for all of a class.
    """

    def __init__(self, codes: int = 0):
        self.codes = codes

    def numbers(self, x: np.ndarray) -> np.ndarray:
        return x[:, : x.shape[1] - self.codes - 1] if self.codes else x

    def squares(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Squared distances by a matrix product, not exact."""
        p, q = self.numbers(a), self.numbers(b)
        out = p @ (-2 * q.T)
        out += np.einsum("ij,ij->i", q, q)
        out += np.einsum("ij,ij->i", p, p)[:, None]
        np.maximum(out, 0, out=out)
        for j in range(self.codes):
            out += a[:, -1:] * (a[:, -2 - j, None] != b[:, -2 - j])
        return out

    def slack(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How far ``squares`` may be off, for each row of ``a``."""
        p, q = self.numbers(a), self.numbers(b)
        size = np.einsum("ij,ij->i", p, p) + np.einsum("ij,ij->i", q, q).max(initial=0.0)
        return 8 * (a.shape[1] + 4) * np.finfo(float).eps * (size + (a[:, -1] * self.codes if self.codes else 0))

    def exact(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distance of each row of ``a`` from that of ``b``, in the order of the plain sum, so equal distances stay equal."""
        each = np.arange(len(a))
        return self.between(np.asfortranarray(a), each, np.asfortranarray(b), each)

    def between(self, a: np.ndarray, r: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """``exact`` of the rows ``r`` of ``a`` and ``c`` of ``b``, whose columns lie together."""
        p, q = self.numbers(a), self.numbers(b)
        square = np.zeros(len(r))
        for d in range(p.shape[1]):
            away = p[:, d].take(r)
            away -= q[:, d].take(c)
            away *= away
            square += away
        if self.codes:
            unequal = np.zeros(len(r), np.int64)
            for j in range(self.codes):
                unequal += a[r, -2 - j] != b[c, -2 - j]
            square += a[r, -1] * unequal
        return np.sqrt(square)


class Best:
    """The ``k`` nearest candidates so far of each of some vectors, by distance, then key.

    Candidates are gathered until they are as many as those held, and then settled together.
    """

    def __init__(self, queries: np.ndarray, k: int, metric: Metric):
        self.x, self.k, self.metric = queries, k, metric
        self.row = np.zeros(0, np.int64)
        self.distance = np.zeros(0)
        self.key: np.ndarray | None = None
        self.label: np.ndarray | None = None
        self.bound = np.full(len(queries), np.inf)  # the k-th distance, once there are k
        self.more: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def take(self, points: np.ndarray, keys: np.ndarray, labels: np.ndarray) -> None:
        """Candidates; a matrix product tells which may be near enough, those are measured in full."""
        for at in range(0, len(points), COLUMNS):
            some = points[at : at + COLUMNS]
            for first in range(0, len(self.x), ROWS):
                r, c, distance = self._near(first, some)
                if len(r):
                    self.more.append((r, distance, keys[at + c], labels[at + c]))
                    self.waiting += len(r)
            if self.waiting > max(1 << 17, len(self.row)):
                self.settle()

    def _near(self, first: int, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, place and distance of the points that may be among the nearest of ``ROWS`` vectors."""
        x, bound = self.x[first : first + ROWS], self.bound[first : first + ROWS]
        rough, slack = self.metric.squares(x, points), self.metric.slack(x, points)
        limit = bound**2 * (1 + ROOM) + slack
        hit = rough <= limit[:, None]
        if len(points) > self.k and np.count_nonzero(hit) > 2 * self.k * len(x):  # no more than k of these points can stay
            limit = np.minimum(limit, np.partition(rough, self.k - 1, axis=1)[:, self.k - 1] + 2 * slack)
            hit = rough <= limit[:, None]
        r, c = np.divmod(np.flatnonzero(hit), len(points))
        distance = self.metric.between(np.asfortranarray(x), r, np.asfortranarray(points), c)
        near = distance <= bound[r]
        return r[near] + first, c[near], distance[near]

    def settle(self) -> None:
        """Keep the ``k`` nearest of all candidates."""
        if not self.more:
            return
        row, distance, key, label = (np.concatenate(v) for v in zip(*self.more, strict=True))
        self.more, self.waiting = [], 0
        if self.key is not None:
            row, distance, key, label = (np.concatenate(v) for v in ((self.row, row), (self.distance, distance), (self.key, key), (self.label, label)))
        order = np.argsort(distance)
        order = order[np.argsort(row[order].astype(np.uint16) if len(self.x) <= 1 << 16 else row[order], kind="stable")]
        if ((row[order[1:]] == row[order[:-1]]) & (distance[order[1:]] == distance[order[:-1]])).any():  # equal distances are in the order of keys
            order = np.lexsort((key if key.dtype != object else np.unique(key, return_inverse=True)[1], distance, row))
        row = row[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row, "left") < self.k
        order = order[keep]
        self.row, self.distance, self.key, self.label = row[keep], distance[order], key[order], label[order]
        full = np.flatnonzero(np.bincount(self.row, minlength=len(self.x)) >= self.k)
        last = np.searchsorted(self.row, full, "right") - 1
        self.bound[full] = self.distance[last]

    def lists(self, key_type: pa.DataType, label_type: pa.DataType) -> pa.Array:
        """Each vector's neighbours in order: distance, key and label."""
        self.settle()
        edge = np.searchsorted(self.row, np.arange(len(self.x) + 1)).astype(np.int32)
        key, label = ([] if v is None else v for v in (self.key, self.label))
        near = pa.StructArray.from_arrays([pa.array(self.distance, pa.float64()), pa.array(key, key_type), pa.array(label, label_type)], ["distance", "other", "other_label"])
        return pa.ListArray.from_arrays(pa.array(edge, pa.int32()), near)


class _Blocks:
    """The blocks' places: class code, pivot, and the ring of distances around it."""

    def __init__(self, pivots: np.ndarray, table: list[tuple[int, int, int, float, float]], metric: Metric):
        self.pivots, self.metric = pivots, metric
        self.id, self.own, self.cell = (np.array([r[i] for r in table], np.int64) for i in range(3))
        self.low, self.high = (np.array([r[i] for r in table]) for i in (3, 4))

    def reached(self, block: int, points: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Blocks that may hold something within the rows' bounds, nearest first, and how near."""
        square, slack = self.metric.squares(points, self.pivots), self.metric.slack(points, self.pivots)[:, None]
        most, least = np.sqrt(square + slack), np.sqrt(np.maximum(square - slack, 0))
        mine = np.flatnonzero(self.own == self.own[self.id == block][0])
        near = np.full(len(mine), np.inf)
        hit = np.zeros(len(mine), bool)
        for a in range(0, len(mine), 4096):
            some = mine[a : a + 4096]
            cell = self.cell[some]
            gap = np.maximum(np.maximum(least[:, cell] - self.high[some], self.low[some] - most[:, cell]), 0)
            room = ROOM * (1 + self.high[some] + bound[:, None].clip(max=1e300))
            hit[a : a + 4096] = (gap <= bound[:, None] + room).any(axis=0)
            near[a : a + 4096] = gap.min(axis=0)
        found = mine[hit]
        home = self.id[found] != block  # its own block comes first
        order = np.lexsort((self.id[found], near[hit], home))
        return self.id[found][order], near[hit][order]


def _places(distinct: DataFrame, pivots: np.ndarray, block: int, metric: Metric) -> tuple[DataFrame, _Blocks]:
    """``distinct(class, key, label, v, first)`` with ``block``, written, and the blocks."""

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = _matrix(part.column("v"))
                cell = metric.squares(x, pivots).argmin(axis=1)
                away = metric.exact(x, pivots[cell])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(away)], [*part.schema.names, "cell", "away"])

    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in distinct.schema)
    celled = stored(distinct.mapInArrow(assign, names + ", cell int, away double"), "neighbour-cells")
    cuts = [k / 64 for k in range(1, 64)]
    sizes = celled.groupBy("class", "cell").agg(F.count("*").alias("n"), F.percentile_approx("away", cuts, F.lit(1000)).alias("cuts"))
    every = F.greatest(F.lit(1), F.ceil(64 * block / F.col("n")).cast("int"))  # of the cuts, so many apart
    edges = F.array_distinct(F.filter(F.col("cuts"), lambda c, i: (i + 1) % every == 0))
    ringed = celled.join(sizes.select("class", "cell", edges.alias("edges")), ["class", "cell"]).withColumn("ring", F.size(F.filter("edges", lambda e: e < F.col("away")))).drop("edges")
    # a ring of too many vectors, as where all are as far from the pivot, is split by their keys
    rings = ringed.groupBy("class", "cell", "ring").agg(F.count("*").alias("n"), F.min("away").alias("low"), F.max("away").alias("high"))
    many = stored(rings.withColumn("parts", F.ceil(F.col("n") / (2 * block)).cast("int")), "neighbour-rings")
    found = many.orderBy("class", "cell", "ring").collect()  # a row for every ``block`` vectors or so
    codes: dict = {}
    table, numbered = [], []
    for r in found:
        own = codes.setdefault(r["class"], len(codes))
        numbered.append((own, r["cell"], r["ring"], len(table), r["parts"]))
        table += [(len(table) + i, own, r["cell"], r["low"], r["high"]) for i in range(r["parts"])]
    spark = distinct.sparkSession
    classes = spark.createDataFrame(list(codes.items()), "class string, own long")
    ids = spark.createDataFrame(numbered, "own long, cell int, ring int, base long, parts int")
    placed = ringed.join(classes, "class").join(ids, ["own", "cell", "ring"])
    placed = placed.withColumn("block", F.col("base") + F.pmod(F.xxhash64("key"), F.col("parts")))
    out = stored(placed.select("block", "key", "label", "v", "first"), "neighbour-blocks")
    discarded(celled, many)
    # room for the rounding of these distances
    wide = [(i, own, cell, low * (1 - 1e-6) - 1e-9, high * (1 + 1e-6) + 1e-9) for i, own, cell, low, high in table]
    return out, _Blocks(pivots, wide, metric)


def _groups(reached: DataFrame, blocks: _Blocks, most: int) -> DataFrame:
    """``asking, group`` of every block that asks: up to ``most`` blocks of a class that each reach over half of its blocks are one group."""
    counts = dict(map(tuple, reached.groupBy("asking").count().collect()))  # a row for every ``block`` vectors
    own = dict(zip(blocks.id.tolist(), blocks.own.tolist(), strict=True))
    sizes = dict(zip(*(v.tolist() for v in np.unique(blocks.own, return_counts=True)), strict=True))
    wide = [b for b in sorted(counts, key=lambda b: (own[b], b)) if 2 * counts[b] > sizes[own[b]]]
    size = max(1, min(most, len(wide) // GROUPS))
    group = {b: b for b in counts}
    heads: dict = {}  # of each class: the group that is being filled, and its blocks
    for b in wide:
        head, n = heads.get(own[b], (b, size))
        head, n = (b, 0) if n >= size else (head, n)
        group[b], heads[own[b]] = head, (head, n + 1)
    return reached.sparkSession.createDataFrame(list(group.items()), "asking long, group long").hint("broadcast")


def searched(distinct: DataFrame, k: int, block: int = BLOCK, most_pivots: int = PIVOTS, measured: Accumulator | None = None, metric: Metric | None = None) -> DataFrame:
    """``key, near``: the ``k`` nearest, itself included, of the rows of ``distinct`` that are ``first``.

    ``distinct(class, key, label, v, first)``: ``class`` is a text, vectors of one length and finite numbers, keys
    that are not null. Neighbours are of the row's class. ``near`` is an array of distance, key
    and label, in the order of distance and key. ``measured`` adds up the pairs looked at.
    """
    spark, metric = distinct.sparkSession, metric or Metric()
    size = distinct.groupBy("class").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    block = max(block, 2 * k)
    wanted = min(most_pivots, max(1, math.ceil(size / block)))
    some = distinct.where("first").orderBy(F.xxhash64("key"), "key").limit(wanted).select("v").toArrow().combine_chunks()
    pivots = np.array(some.column("v").to_pylist(), float)
    if not len(pivots):
        kinds = {f.name: f.dataType.simpleString() for f in distinct.schema}
        return spark.createDataFrame([], f"key {kinds['key']}, near array<struct<distance: double, other: {kinds['key']}, other_label: {kinds['label']}>>")
    placed, blocks = _places(distinct, pivots, block, metric)
    held, n_blocks = spark.sparkContext.broadcast(blocks), len(blocks.id)  # some forty bytes for every ``block`` vectors, and the pivots

    def reach(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        here = group.column("block")[0].as_py()
        points = _matrix(group.column("v").chunk(0) if group.num_rows else group.column("v"))
        asked = np.flatnonzero(group.column("first").to_numpy())
        best = Best(points[asked], k, metric)
        best.take(points, np.arange(len(points)), np.zeros(len(points), np.int8))
        best.settle()
        if measured is not None:
            measured.add(len(asked) * len(points))
        found = held.value.reached(here, points[asked], best.bound)[0] if len(asked) else np.zeros(0, np.int64)
        return pa.table({"asking": pa.array(np.full(len(found), here)), "block": pa.array(found), "at": pa.array(np.arange(len(found)))})

    reached = stored(placed.select("block", "v", "first").groupBy("block").applyInArrow(reach, "asking long, block long, at long"), "neighbour-reached")
    groups = _groups(reached, blocks, max(1, min(JOINED, KEPT // (k * block))))
    reached = reached.join(groups, "asking").groupBy("group", "block").agg(F.min("at").alias("at"))
    stripe = F.floor(F.col("at") / STRIPE)
    met = reached.join(placed.drop("first"), "block").select(F.col("group").alias("asking"), stripe.alias("stripe"), "at", "key", "label", "v")
    stripes = reached.groupBy("group").agg(F.max(stripe).alias("stripes")).join(groups, "group").select("group", "stripes", F.col("asking").alias("block"))
    asked = placed.where("first").join(stripes, "block").select(F.col("group").alias("asking"), F.explode(F.sequence(F.lit(0).cast("long"), "stripes")).alias("stripe"), F.lit(-1).cast("long").alias("at"), "key", "label", "v")
    stream = asked.unionByName(met)
    kinds = {c: stream.schema[c].dataType for c in ("key", "label")}
    key_type, label_type = (to_arrow_type(kinds[c]) for c in ("key", "label"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: tuple | None = None
        queries: list[tuple[np.ndarray, np.ndarray]] = []
        best: Best | None = None

        def done() -> Iterator[pa.RecordBatch]:
            if best is not None:
                keys, near = np.concatenate([q[0] for q in queries]), best.lists(key_type, label_type)
                step = max(1, (1 << 20) // k)  # rows of a batch
                for at in range(0, len(keys), step):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + step], key_type), near.slice(at, step)], ["key", "near"])

        for batch in batches:
            where = np.stack([batch.column(c).to_numpy() for c in ("asking", "stripe")], axis=1)
            asks = batch.column("at").to_numpy() < 0
            edge = np.flatnonzero(np.r_[True, (where[1:] != where[:-1]).any(axis=1) | (asks[1:] != asks[:-1])]) if len(where) else []
            for a, b in zip(edge, [*edge[1:], len(where)], strict=True):
                part, now = batch.slice(a, b - a), tuple(where[a])
                if now != place:
                    yield from done()
                    place, queries, best = now, [], None
                if asks[a]:
                    queries.append((_keys(part.column("key")), _matrix(part.column("v"))))
                elif queries:
                    if best is None:
                        best = Best(np.concatenate([q[1] for q in queries]), k, metric)
                    points = _matrix(part.column("v"))
                    if measured is not None:
                        measured.add(len(points) * len(best.x))
                    best.take(points, _keys(part.column("key")), _labels(part.column("label")))
        yield from done()

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(n_blocks // 8, 20_000))
    dealt = stream.repartition(parts, "asking", "stripe").sortWithinPartitions("asking", "stripe", "at")
    out = dealt.mapInArrow(run, f"key {kinds['key'].simpleString()}, near array<struct<distance: double, other: {kinds['key'].simpleString()}, other_label: {kinds['label'].simpleString()}>>")
    if n_blocks <= STRIPE:
        return out
    each = out.select("key", F.explode("near").alias("x"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy("x.distance", "x.other"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).groupBy("key").agg(F.sort_array(F.collect_list("x")).alias("near"))


def nearest(df: DataFrame, key: str, label: str, vector: str, k: int, include_self: bool = False, within: bool = False, block: int = BLOCK, measured: Accumulator | None = None, codes: int = 0, asked: DataFrame | None = None) -> DataFrame:
    """``key, label, other, other_label, distance, rank``: each row's ``k`` nearest, by distance and key; exact.

    ``within`` keeps to neighbours of the row's label, null being one of them. Rows with a null key take no part; keys
    are taken to name one row. A vector that is null, shorter than the longest, or holds a
    null or a number that is not finite is at an unknown distance from every other: such rows
    come last in the order of their keys, with a null distance, where fewer than ``k`` others
    are left, and their own neighbours are the first keys. An empty table gives an empty one.
    With ``codes``, vectors are mixed ones of a class each (see ``Metric``), for ``within``.
    ``asked(key)`` names the rows whose neighbours are wanted, among all rows; without it all are.
    """
    rows = df.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v")).where("key is not null")
    width = rows.agg(F.max(F.size("v"))).first()[0]
    width = max(0, -1 if width is None else width)
    known = F.coalesce(F.size("v") == width, F.lit(False)) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.lit(width > 0)
    rows = rows.withColumn("class", F.when(F.col("label").isNull(), "").otherwise(F.concat(F.lit("="), F.col("label").cast("string"))) if within else F.lit("")).withColumn("known", F.coalesce(known, F.lit(False)))
    if asked is not None:
        asked = stored(asked.select("key").where("key is not null").distinct(), "neighbours-asked")
        if asked.limit(FEW * PASSES + 1).count() <= FEW * PASSES:
            near = _of_few(stored(rows, "neighbour-rows"), asked, k + 1, Metric(codes))
            return _ranked(_with_unknown(rows, near, k).join(asked, "key", "left_semi"), k, include_self)
    # of rows that share a vector, no other needs more than the first k + 1
    place = F.row_number().over(Window.partitionBy("class", "known", "v").orderBy("key"))
    ranked = stored(rows.where("known").withColumn("place", place), "neighbour-rows")
    first = ranked.where(F.col("place") <= k + 1).select("class", "key", "label", "v", (F.col("place") == 1).alias("first"))
    found = stored(searched(first, k + 1, block, measured=measured, metric=Metric(codes)), "neighbours")
    heads = ranked.where("place = 1").join(found, "key").select("class", "key", "label", "v", "near")
    near = heads.select("class", "key", "label", "near")
    if ranked.where("place > 1").limit(1).count():
        copies = ranked.where("place > 1").select("class", "key", "label", "v")
        heads = heads.select(F.col("class").alias("c"), F.col("v").alias("u"), "near")
        near = near.unionByName(copies.join(heads, (copies["class"] == heads["c"]) & (copies["v"] == heads["u"])).select("class", "key", "label", "near"))
    near = _with_unknown(rows, near, k)
    return _ranked(near if asked is None else near.join(asked, "key", "left_semi"), k, include_self)


def _of_few(rows: DataFrame, asked: DataFrame, k: int, metric: Metric) -> DataFrame:
    """``class, key, label, near`` of the asked rows of known vectors: every task finds the nearest of its rows to all of them, and those are put together."""
    spark = rows.sparkSession
    known = rows.where("known").select("class", "key", "label", "v")
    queries = known.join(asked, "key", "left_semi")
    kinds = {f.name: f.dataType.simpleString() for f in known.schema}
    key_type, label_type = (to_arrow_type(known.schema[c].dataType) for c in ("key", "label"))
    near_kind = f"array<struct<distance: double, other: {kinds['key']}, other_label: {kinds['label']}>>"
    table = queries.limit(FEW * PASSES).toArrow().combine_chunks()  # as many at most
    out = spark.createDataFrame([], f"class string, key {kinds['key']}, label {kinds['label']}, near {near_kind}")
    for at in range(0, table.num_rows, FEW):
        part = table.slice(at, FEW).combine_chunks()
        classes = part.column("class").to_pylist()
        keys, v = part.column("key").chunk(0), _matrix(part.column("v").chunk(0))
        places: dict = {}
        for i, c in enumerate(classes):
            places.setdefault(c, []).append(i)
        held = spark.sparkContext.broadcast((keys, v, {c: np.array(i) for c, i in places.items()}))

        def run(batches: Iterable[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            keys, v, places = held.value
            best = {c: Best(v[i], k, metric) for c, i in places.items()}
            for batch in batches:
                codes = batch.column("class").dictionary_encode()
                index = codes.indices.to_numpy()
                for j, c in enumerate(codes.dictionary.to_pylist()):
                    if c in best:
                        mine = batch.filter(pa.array(index == j))
                        best[c].take(_matrix(mine.column("v")), _keys(mine.column("key")), _labels(mine.column("label")))
            for c, i in places.items():
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(i)), best[c].lists(key_type, label_type)], ["key", "near"])

        each = known.mapInArrow(run, f"key {kinds['key']}, near {near_kind}").select("key", F.explode("near").alias("x"))
        rank = F.row_number().over(Window.partitionBy("key").orderBy("x.distance", "x.other"))
        near = each.withColumn("rank", rank).where(F.col("rank") <= k).groupBy("key").agg(F.sort_array(F.collect_list("x")).alias("near"))
        out = out.unionByName(queries.select("class", "key", "label").join(near, "key"))
    return stored(out, "neighbours")


def _ranked(near: DataFrame, k: int, include_self: bool) -> DataFrame:
    """The lists as rows."""
    others = F.slice(F.col("near") if include_self else F.filter("near", lambda x: x["other"] != F.col("key")), 1, k)
    flat = near.select("key", "label", F.posexplode(others).alias("at", "x"))
    return flat.select("key", "label", "x.other", "x.other_label", "x.distance", (F.col("at") + 1).alias("rank"))


def _with_unknown(rows: DataFrame, near: DataFrame, k: int) -> DataFrame:
    """``near`` with rows of unknown distance at its ends where it is short, and those rows with their own."""
    unknown = rows.where("not known")
    if not unknown.limit(1).count():
        return near
    order = Window.partitionBy("class").orderBy("other")
    listed = lambda some, name: some.select("class", F.col("key").alias("other"), F.col("label").alias("other_label")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).groupBy("class").agg(F.sort_array(F.collect_list(F.struct("other", "other_label"))).alias(name))
    listing = F.transform("listed", lambda x: F.struct(F.lit(None).cast("double").alias("distance"), x["other"].alias("other"), x["other_label"].alias("other_label")))
    kind = near.schema["near"].dataType.simpleString()
    last, first = (listed(some, "listed").select("class", listing.cast(kind).alias("more")) for some in (unknown, rows))
    longer = near.join(F.broadcast(last), "class", "left")  # a list of k + 1 for each class
    more = F.when((F.size("near") > k) | F.col("more").isNull(), F.col("near")).otherwise(F.concat("near", "more"))
    return longer.select("class", "key", "label", more.alias("near")).unionByName(unknown.join(F.broadcast(first), "class").select("class", "key", "label", F.col("more").alias("near")))
