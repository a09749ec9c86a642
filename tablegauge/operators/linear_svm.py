"""Linear support-vector machines of all classes at once, in a bounded number of passes.

The hinge is rounded off over a width that shrinks from pass to pass, which makes each step
a damped Newton step. A pass adds up loss, gradient and curvature of every class's machine
that is not done; a task hands on that many numbers, whatever its rows. Line searches on
the hinge itself, which stall at its kinks, are not needed. Rows are written once in
blocks of bytes, so that a pass does not convert them again.
"""

from __future__ import annotations

from collections.abc import Generator, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Widths over which the hinge is rounded: the first takes in every row at the start, the last is far below a margin of 1.
WIDEST, NARROWEST, NARROWER = 4.0, 1e-5, 8.0
#: Passes over the rows, and steps at one width, at most.
PASSES, STEPS = 80, 12
#: Rows of a block.
BLOCK = 4096

Sums = tuple[float, np.ndarray, np.ndarray]


def packed(rows: DataFrame) -> DataFrame:
    """Blocks of ``rows(y, x)``: ``n, y, x`` as bytes, with the ``classes`` seen, the columns' ``mean`` and their centred squares ``m2``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            y, x = batch.column("y").to_numpy(), batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            parts = [(y[k : k + BLOCK], x[k : k + BLOCK]) for k in range(0, len(y), BLOCK)]
            means = [v.mean(axis=0) for _, v in parts]
            out = [pa.array([len(u) for u, _ in parts], pa.int32()), pa.array([u.tobytes() for u, _ in parts]), pa.array([v.tobytes() for _, v in parts])]
            out += [pa.array(c, pa.list_(pa.float64())) for c in ([np.unique(u) for u, _ in parts], means, [((v - m) ** 2).sum(axis=0) for (_, v), m in zip(parts, means, strict=True)])]
            yield pa.RecordBatch.from_arrays(out, ["n", "y", "x", "classes", "mean", "m2"])

    return rows.select("y", "x").mapInArrow(run, "n int, y binary, x binary, classes array<double>, mean array<double>, m2 array<double>")


def _unpacked(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``y`` and ``x`` of each block."""
    for batch in batches:
        for n, y, x in zip(batch.column("n").to_pylist(), batch.column("y"), batch.column("x"), strict=True):
            yield np.frombuffer(y.as_buffer(), float), np.frombuffer(x.as_buffer(), float).reshape(n, -1)


def _machine(p: int, penalty: np.ndarray) -> Generator[tuple[np.ndarray, float], Sums, np.ndarray]:
    """Asks for the sums at weights and a width, and returns the weights, the intercept last."""

    def whole(got: Sums, at: np.ndarray) -> Sums:
        return got[0] + 0.5 * float(penalty @ (at * at)), got[1] + penalty * at, got[2] + np.diag(penalty)

    now, width, damping = np.zeros(p + 1), WIDEST, 1e-6
    while True:
        f, g, h = whole((yield now, width), now)
        for _ in range(STEPS):
            step = -np.linalg.solve(h + damping * max(float(h.diagonal().max()), 1e-12) * np.eye(p + 1), g)
            gain = -float(g @ step)
            if gain < (1e-9 if width <= NARROWEST else width / 1000):
                break
            f2, g2, h2 = whole((yield now + step, width), now + step)
            if f2 <= f - 1e-4 * gain:
                now, f, g, h, damping = now + step, f2, g2, h2, max(damping / 10, 1e-9)
            else:
                damping = min(max(damping * 30, 1e-4), 1e3)
        if width <= NARROWEST:
            return now
        width = max(width / NARROWER, NARROWEST)


def _pass(blocks: DataFrame, centre: np.ndarray, scale: np.ndarray, asked: dict[int, tuple[np.ndarray, float]]) -> dict[int, np.ndarray]:
    """For each class asked for, loss, gradient and curvature, added up over the rows."""
    p = len(centre)
    held = blocks.sparkSession.sparkContext.broadcast((centre, scale, asked))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mid, by, machines = held.value
        sums = {c: np.zeros(1 + (p + 1) * (p + 2)) for c in machines}
        for y, x in _unpacked(batches):
            u = np.ones((len(y), p + 1))
            u[:, :p] = (x - mid) * by
            for c, (weights, width) in machines.items():
                sign = np.where(y == c, 1.0, -1.0)
                slack = 1 - sign * (u @ weights) + width / 2
                share = np.clip(slack / width, 0, 1)
                bent = u[(slack > 0) & (slack < width)]
                s = sums[c]
                s[0] += (width / 2 * share * share + np.maximum(slack - width, 0)).sum()
                s[1 : p + 2] -= (share * sign) @ u
                s[p + 2 :] += (bent.T @ bent / width).ravel()
        for c, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), c, np.int32)), pa.array(np.arange(len(s), dtype=np.int32)), pa.array(s)], ["c", "i", "v"])

    out = {c: np.zeros(1 + (p + 1) * (p + 2)) for c in asked}
    for r in blocks.select("n", "y", "x").mapInArrow(run, "c int, i int, v double").groupBy("c", "i").agg(F.sum("v").alias("v")).collect():  # classes times columns squared
        out[r["c"]][r["i"]] = r["v"]
    held.unpersist()
    return out


def fitted(blocks: DataFrame, most_passes: int = PASSES) -> dict[int, np.ndarray]:
    """For each class its machine (C = 1) against the rest of what is ``packed``: weights of the columns, the intercept last.

    Of two classes, only that of the second. ``blocks`` should be written: each of at most
    ``most_passes`` passes reads them. Values are neither null nor NaN. Columns are scaled
    to search, the penalty is on the weights as they are. Raises ``ValueError`` without rows.
    """
    columns = blocks.select("n", F.posexplode("mean").alias("i", "mean"), F.col("m2")[F.col("i")].alias("m2"))
    first = columns.groupBy("i").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean")).orderBy("i").collect()  # a row per column
    if not first:
        raise ValueError("no rows to learn from")
    n, centre = first[0]["n"], np.array([r["mean"] for r in first])
    off = F.col("mean") - F.array(*[F.lit(float(v)) for v in centre])[F.col("i")]
    squares = {r["i"]: r["m2"] for r in columns.groupBy("i").agg(F.sum(F.col("m2") + F.col("n") * off * off).alias("m2")).collect()}
    spread = np.sqrt(np.array([squares[i] for i in range(len(centre))]) / n)
    k = blocks.select(F.explode("classes").alias("y")).distinct().count()
    if k == 1:  # nothing to tell apart: the rest alone, at its margin
        return {1: np.r_[np.zeros(len(centre)), -1.0]}
    scale = np.divide(1.0, spread, out=np.zeros_like(spread), where=spread > 0)  # a constant column gets no weight
    p, penalty = len(centre), np.r_[scale * scale / n, 0.0]
    penalty[:p][scale == 0] = 1.0
    classes = list(range(k)) if k > 2 else [1]
    machines = {c: _machine(p, penalty) for c in classes}
    asked = {c: next(m) for c, m in machines.items()}
    best = {c: at for c, (at, _) in asked.items()}
    for _ in range(most_passes):
        got = _pass(blocks, centre, scale, asked)
        for c in list(asked):
            s = got[c] / n
            try:
                asked[c] = machines[c].send((float(s[0]), s[1 : p + 2], s[p + 2 :].reshape(p + 1, p + 1)))
                best[c] = asked[c][0]
            except StopIteration as done:
                best[c] = done.value
                del asked[c]
        if not asked:
            break
    return {c: np.r_[w[:p] * scale, w[p] - float((w[:p] * scale) @ centre)] for c, w in best.items()}


def decided(blocks: DataFrame, machines: dict[int, np.ndarray], signed: bool) -> DataFrame:
    """``x``: the least decision over the machines of each row, of its absolute values where not ``signed``."""
    weights = np.stack(list(machines.values()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x in _unpacked(batches):
            d = x @ weights[:, :-1].T + weights[:, -1]
            yield pa.RecordBatch.from_arrays([pa.array((d if signed else np.abs(d)).min(axis=1))], ["x"])

    return blocks.select("n", "y", "x").mapInArrow(run, "x double")
