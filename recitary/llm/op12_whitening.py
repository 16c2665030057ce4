"""Embedding whitening by a one-sided Jacobi SVD of a blockwise QR.

Entries are put on a grid of 1/64 as whole numbers x, so that counts, sums and deviations
are exact. Blocks of centred rows are compressed by QR to their triangle R, triangles of
several blocks by QR again, in a tree, until one is left: R'R is n times the covariance,
and no product of rows was formed on the way. Plane rotations make the columns of R
orthogonal; the rotations, accumulated, are the components, and the columns' lengths the
singular values, small ones as accurate as large ones. Rows are centred as
(x - S // n) - (S % n) / n, which loses nothing to cancellation.

What reaches the driver are sums by dimension, one triangle and one matrix of moments: they
grow with the dimension, not with the rows.

Edge cases. Vectors that are null or hold null, NaN or infinite entries are left out, and so
are entries too large for the grid (2^53 / 64 or more in size), and vectors whose length is not
the commonest one (of the longer ones where two are as common): they have no place in one
covariance. Repeated rows count as often as they occur; a null vec_id is kept. Directions
without variance (constant or dependent dimensions, fewer rows than dimensions) have no
whitened value, so they are no components: there are as many as the rank says, 32 at most, and
none for a single row, for equal rows or for an empty table. Equal eigenvalues have some
orthonormal basis, the same for all rows. A deviation beyond a long is null. Further columns
are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

GRID, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Rows that one QR takes at once, and triangles or moments that one task merges.
BLOCK, FAN_IN = 4096, 16


@dataclass
class Whitening:
    """mean: (whole, rest) by dimension, rest below one; components: (dimension, k); sd: their
    standard deviations; trace: of the covariance; n: rows; sums: exact sums by dimension."""

    n: int
    sums: np.ndarray
    whole: np.ndarray
    rest: np.ndarray
    components: np.ndarray
    sd: np.ndarray
    trace: float


def grid(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and x, the vector on the grid as array<bigint>; unusable vectors are left out."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float(1 << 53) / GRID))
    rows = vectors.where(F.col(vector).isNotNull()).where(fine & (F.size(vector) > 0))
    return rows.select(F.col(vec_id).alias("vec_id"), F.transform(v, lambda c: F.floor(GRID * c) + OFFSET).alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """The rows of a list column whose lists all have d entries."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each length and dimension: the number of rows and their sum."""
    total: dict[int, tuple[int, list[int]]] = {}
    for b in batches:
        x = b.column("x")
        sizes = np.asarray(x.value_lengths())
        for d in np.unique(sizes).tolist():
            own = _matrix(x.filter(pa.array(sizes == d)), d)
            # sums of a batch may pass a long only where entries are huge
            sums = own.sum(0) if np.abs(own).max() < 1 << 40 else own.astype(object).sum(0)
            n, s = total.get(d, (0, [0] * d))
            total[d] = n + len(own), [a + int(c) for a, c in zip(s, sums, strict=True)]
    rows = [(d, k, n, Decimal(c)) for d, (n, s) in total.items() for k, c in enumerate(s)]
    names, kinds = ("d", "k", "n", "s"), (pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0))
    yield pa.record_batch([pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)], list(names))


def centred(x: np.ndarray, whole: np.ndarray, rest: np.ndarray) -> np.ndarray:
    return (x - whole).astype(np.float64) - rest


def _triangle(rows: np.ndarray) -> np.ndarray:
    """R of the QR of rows, with as many rows as columns."""
    d = rows.shape[1]
    r = np.linalg.qr(rows, mode="r") if len(rows) else np.zeros((0, d))
    return np.vstack([r, np.zeros((d - len(r), d))]) if len(r) < d else r


def merge_tree(parts: DataFrame, merge: Callable[[list[np.ndarray]], np.ndarray], ws: Workspace, name: str) -> np.ndarray | None:
    """parts: a `value` (array<double>) for each block. Values are merged FAN_IN at a time by
    Spark tasks, round after round, until one is left, which the driver gets."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        held = t.column("value").combine_chunks()
        # in the order of the blocks' numbers, so that a rerun rounds alike
        rows = _matrix(held, len(held.flatten()) // len(held))[np.argsort(t.column("block").to_numpy(), kind="stable")]
        return pa.table({"block": pa.array([int(key[0].as_py())], pa.int64()), "value": pa.array([merge(list(rows))], pa.list_(pa.float64()))})

    parts, k = ws.write(parts.select("block", "value"), f"{name}0"), 0
    while (n := parts.count()) > 1:
        into = F.floor(F.col("block") / FAN_IN) if n > FAN_IN else F.lit(0).cast("long")
        k += 1
        parts = ws.write(parts.withColumn("into", into).groupBy("into").applyInArrow(run, "block long, value array<double>"), f"{name}{k}")
    got = parts.collect()
    return np.array(got[0]["value"]) if got else None


def jacobi(r: np.ndarray, sweeps: int = 60, tolerance: float = 1e-15) -> tuple[np.ndarray, np.ndarray]:
    """Singular values, falling, and right vectors of r. Each step rotates disjoint pairs of columns so
    that they are orthogonal, in a round-robin over all pairs, until a sweep finds none to rotate."""
    d = r.shape[1]
    a, v = r.astype(np.float64).copy(), np.eye(d)
    m = d + d % 2
    for _ in range(sweeps):
        turned = False
        ring = list(range(m))
        for _ in range(m - 1):
            pairs = [(min(p, q), max(p, q)) for p, q in zip(ring[: m // 2], ring[: m // 2 - 1 : -1], strict=True) if max(p, q) < d]
            ring = [ring[0], ring[-1], *ring[1:-1]]
            if not pairs:
                continue
            p, q = np.array(pairs).T
            x, y = a[:, p], a[:, q]
            alpha, beta, gamma = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            turn = np.abs(gamma) > tolerance * np.sqrt(alpha * beta)
            if not turn.any():
                continue
            turned = True
            p, q, alpha, beta, gamma = p[turn], q[turn], alpha[turn], beta[turn], gamma[turn]
            zeta = (beta - alpha) / (2 * gamma)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            s = c * t
            for w in (a, v):
                x, y = w[:, p].copy(), w[:, q].copy()
                w[:, p], w[:, q] = c * x - s * y, s * x + c * y
        if not turned:
            break
    size = np.sqrt((a * a).sum(0))
    order = np.argsort(-size, kind="stable")
    v = v[:, order]
    # the sign that makes the largest entry positive
    v = v * np.where(v[np.abs(v).argmax(0), np.arange(d)] < 0, -1.0, 1.0)
    return size[order], v


def fit(rows: DataFrame, ws: Workspace, most: int = COMPONENTS) -> Whitening | None:
    """rows: x on the grid. None without rows."""
    counted = rows.select("x").mapInArrow(_sums, "d int, k int, n long, s decimal(38,0)").groupBy("d", "k").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    counted = ws.write(counted, "sums")
    top = counted.where("k = 0").orderBy(F.desc("n"), F.desc("d")).first()
    if top is None:
        return None
    d, n = top["d"], top["n"]
    sums = [int(r["s"]) for r in counted.where(F.col("d") == d).orderBy("k").collect()]
    whole = np.array([s // n for s in sums], dtype=np.int64)
    rest = np.array([(s % n) / n for s in sums])

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, held, size = np.zeros((0, d)), [], 0
        for b in batches:
            held.append(centred(_matrix(b.column("x"), d), whole, rest))
            size += len(held[-1])
            if size >= BLOCK:
                r, held, size = _triangle(np.vstack([r, *held])), [], 0
        if held or len(r):
            r = _triangle(np.vstack([r, *held]))
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.ravel()], pa.list_(pa.float64()))], ["block", "value"])

    triangles = rows.where(F.size("x") == d).select("x").mapInArrow(compress, "block long, value array<double>")
    r = merge_tree(triangles, lambda parts: _triangle(np.vstack([p.reshape(d, d) for p in parts])).ravel(), ws, "triangles").reshape(d, d)
    size, v = jacobi(r)
    k = min(most, int((size > d * np.finfo(float).eps * max(size[0], 1e-300)).sum()), max(0, n - 1))
    # rounding leaves some 1e-13 of a constant dimension; whole numbers vary by more than that if at all
    k = min(k, int((size**2 > 1e-12).sum()))
    return Whitening(n, np.array(sums, dtype=object), whole, rest, v[:, :k], size[:k] / np.sqrt(n), float((size**2).sum() / n))


def project(x: np.ndarray, w: Whitening) -> np.ndarray:
    return centred(x, w.whole, w.rest) @ w.components / w.sd


def deviations(x: np.ndarray, w: Whitening) -> list[int | None]:
    """The exact sums of (n * x - S)^2."""
    rest = np.array([int(s) - w.n * int(q) for s, q in zip(w.sums, w.whole, strict=True)], dtype=np.int64)
    off = x - w.whole
    bound = (float(np.abs(off).max(initial=0)) + 1) * w.n
    if bound * bound * max(1, x.shape[1]) < 2.0**62:
        own = off * w.n - rest
        return (own * own).sum(1).tolist()
    exact = [sum((int(a) * w.n - int(b)) ** 2 for a, b in zip(row, rest, strict=True)) for row in off.tolist()]
    return [e if e < 1 << 63 else None for e in exact]


def identity_error(rows: DataFrame, w: Whitening, ws: Workspace) -> float:
    """The largest entry of the whitened rows' covariance less the identity, measured on all rows:
    blocks are centred at their own means before they are multiplied, and merged pairwise."""
    own, d, k = rows.sparkSession.sparkContext.broadcast(w), len(w.whole), len(w.sd)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            y = project(_matrix(b.column("x"), d), own.value)
            if len(y):
                m = y.mean(0)
                part = np.r_[len(y), m, ((y - m).T @ (y - m)).ravel()]
                total = part if total is None else merged([total, part])
        if total is not None:
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total], pa.list_(pa.float64()))], ["block", "value"])

    def merged(parts: list[np.ndarray]) -> np.ndarray:
        n, m, c = parts[0][0], parts[0][1 : k + 1], parts[0][k + 1 :].reshape(k, k)
        for p in parts[1:]:
            apart, both = p[1 : k + 1] - m, n + p[0]
            c = c + p[k + 1 :].reshape(k, k) + np.outer(apart, apart) * (n * p[0] / both)
            m, n = m + apart * (p[0] / both), both
        return np.r_[n, m, c.ravel()]

    got = merge_tree(rows.select("x").mapInArrow(moments, "block long, value array<double>"), merged, ws, "moments")
    return float(np.abs(got[k + 1 :].reshape(k, k) / got[0] - np.eye(k)).max())


_OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component: vec_id, component, n, deviation, whitened,
    explained, identity_error."""
    ws = Workspace(vectors.sparkSession, "whitening")
    rows = grid(vectors, vec_id, vector)
    kind = dict(rows.dtypes)["vec_id"]
    w = fit(rows, ws, most)
    if w is None or not len(w.sd):
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, {_OUT}")
    d, k = len(w.whole), len(w.sd)
    rows = rows.where(F.size("x") == d)
    error = identity_error(rows, w, ws)
    own = vectors.sparkSession.sparkContext.broadcast(w)
    explained = w.sd**2 / w.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("x"), d)
            n = len(x)
            at = pa.array(np.repeat(np.arange(n), k))
            columns = [
                b.column("vec_id").take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, own.value.n, dtype=np.int64)),
                pa.array(deviations(x, own.value), pa.int64()).take(at), pa.array(project(x, own.value).ravel()), pa.array(np.tile(explained, n)), pa.array(np.full(n * k, error)),
            ]
            yield pa.record_batch(columns, ["vec_id", *[c.split()[0] for c in _OUT.split(", ")]])

    return rows.mapInArrow(run, f"vec_id {kind}, {_OUT}")


def query(spark, sf_dir):
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
