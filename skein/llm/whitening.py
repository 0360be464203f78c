"""Embedding whitening by a one-sided Jacobi SVD.

Entries c become whole numbers floor(64 * c) + 1000000. Each partition compresses its centred rows, block by block, to a
triangle R (TSQR); triangles meet in a tree of groups, each stacked and compressed again. Plane rotations then make the
columns of the last R orthogonal: the rotations together are the components, the columns' norms over the root of n their
standard deviations. The covariance is never formed, so small deviations keep their digits. What reaches the driver are
sums, components and deviations: numbers by dimension, none by row.

Rows are centred by whole numbers: with S = q * n + r, x - S / n is (x - q) - r / n, and n * x - S is n * (x - q) - r.

Defined results: rows whose vector is null, or holds a null, an entry that is not finite or one of 2 ** 50 or more, are left
out; so are vectors of another length than the most frequent one (of equally frequent ones the longest); components with no
deviation (none is left over 10 ** -12 of the largest: constant or dependent dimensions, fewer rows than dimensions, one row)
can't be whitened and have no rows; a deviation beyond 64 bits is null; equal deviations keep the order of the rotations; of a
component's two signs the one with its largest entry positive; repeated rows and null keys count and are returned each; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import python_batches

SCALE, SHIFT = 64, 1_000_000
#: Components that are returned.
COMPONENTS = 32
#: An entry's size that 64 * c + SHIFT still holds exactly.
LARGEST = 2.0**50
#: Below this part of the largest deviation a component counts as constant.
FLAT = 1e-12
#: Bytes of triangles that one group of the tree stacks.
GROUP_BYTES = 64 << 20
#: Partitions that the tree reaches from its leaves.
LEAVES = 1 << 18
BLOCK = 4096


@dataclass
class Fit:
    """The number of rows, the sums of each dimension, and the components with their deviations, largest first."""

    n: int
    sums: list[int]
    components: np.ndarray  # a row for each
    deviations: np.ndarray
    explained: np.ndarray

    @property
    def width(self) -> int:
        return len(self.sums)


def numbers(vectors: DataFrame, vector: str, width: int | None = None) -> tuple[DataFrame, int]:
    """vectors with _x: the vector's entries as doubles, rows that can't take part left out; and the vectors' length."""
    x = F.col(vector).cast("array<double>")
    fine = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < LARGEST))
    good = vectors.filter(F.coalesce(fine, F.lit(False))).withColumn("_x", x)
    if width is None:
        most = good.groupBy(F.size("_x").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
        width = most["width"] if most else 0
    return good.filter(F.size("_x") == width), width


def whole(batch: pa.RecordBatch, width: int) -> np.ndarray:
    c = batch.column(batch.schema.get_field_index("_x")).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return np.floor(SCALE * c).astype(np.int64) + SHIFT


def from_mean(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """x - q as whole numbers, and x - S / n."""
    q, r = (np.array(v, np.int64) for v in zip(*(divmod(s, n) for s in sums), strict=True))
    d = x - q
    return d, d - r / n


def fold(leaves: DataFrame, combine: Callable[[list[np.ndarray]], np.ndarray], size: int) -> np.ndarray | None:
    """The arrays of (part, value) combined in a tree: groups of neighbouring parts, group by group, level by level."""
    fan = max(2, min(64, GROUP_BYTES // max(1, 8 * size)))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("part")
        return pd.DataFrame({"part": [p["part"].iloc[0] // fan], "value": [combine([np.asarray(v) for v in p["value"]]).ravel()]})

    for _ in range(math.ceil(math.log(LEAVES, fan)) - 1):
        leaves = leaves.groupBy(F.floor(F.col("part") / fan)).applyInPandas(run, "part long, value array<double>")
    got = leaves.groupBy().applyInPandas(run, "part long, value array<double>").collect()  # one row, of a size set by the dimension
    return np.asarray(got[0]["value"]) if got else None


def column_sums(good: DataFrame, width: int) -> tuple[int, list[int]]:
    """Rows and exact sums by dimension: halves of 32 bits are summed, so none overflows before 2 ** 31 rows a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
        for b in batches:
            x = whole(b, width)
            n, high, low = n + len(x), high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0)
        if n:
            yield pa.RecordBatch.from_pydict({"dim": pa.array(range(width), pa.int32()), "n": pa.array([n] * width, pa.int64()), "high": high, "low": low})

    tasks = good.select("_x").mapInArrow(run, "dim int, n long, high long, low long")
    total = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    rows = tasks.groupBy("dim").agg(F.sum("n").alias("n"), total("high"), total("low")).orderBy("dim").collect()
    return (rows[0]["n"], [(int(r["high"]) << 32) + int(r["low"]) for r in rows]) if rows else (0, [])


def triangle(rows: list[np.ndarray], width: int) -> np.ndarray:
    """R of the rows, padded to a square."""
    r = np.linalg.qr(np.concatenate([x.reshape(-1, width) for x in rows]), mode="r")
    return np.concatenate([r, np.zeros((width - len(r), width))])


def tsqr(good: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """R of all centred rows."""
    width = len(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many, part = [], 0, None
        for b in batches:
            part = b.column("part")[0].as_py() if part is None and b.num_rows else part
            held.append(from_mean(whole(b, width), n, sums)[1])
            many += b.num_rows
            if many >= max(BLOCK, 4 * width):
                held, many = [triangle(held, width)], width
        if part is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "value": pa.array([triangle(held, width).ravel()], pa.list_(pa.float64()))})

    leaves = good.select(F.spark_partition_id().cast("long").alias("part"), "_x").mapInArrow(run, "part long, value array<double>")
    return fold(leaves, lambda parts: triangle(parts, width), width * width).reshape(width, width)


def pairings(width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rounds of disjoint pairs, each pair of columns once: one stays, the others go around."""
    ring = list(range(width + width % 2))
    half = len(ring) // 2
    for _ in range(len(ring) - 1):
        pairs = [(p, q) for p, q in zip(ring[:half], ring[:half - 1:-1], strict=True) if p < width and q < width]
        yield tuple(np.array(side) for side in zip(*pairs, strict=True))
        ring = [ring[0], ring[-1], *ring[1:-1]]


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (rows) and singular values of r, largest first, by rotating its columns until any two are
    orthogonal to the last digit."""
    width = r.shape[1]
    a, v = np.ascontiguousarray(r.T), np.eye(width)  # columns as rows
    limit = np.finfo(float).eps
    rounds = list(pairings(width)) if width > 1 else []
    for _ in range(sweeps):
        turned = False
        for p, q in rounds:
            alpha, beta, gamma = (a[p] ** 2).sum(1), (a[q] ** 2).sum(1), (a[p] * a[q]).sum(1)
            turn = np.abs(gamma) > limit * np.sqrt(alpha) * np.sqrt(beta)
            if not turn.any():
                continue
            turned = True
            p, q = p[turn], q[turn]
            zeta = (beta[turn] - alpha[turn]) / (2 * gamma[turn])
            t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            s = c * t
            for m in (a, v):
                m[p], m[q] = c[:, None] * m[p] - s[:, None] * m[q], s[:, None] * m[p] + c[:, None] * m[q]
        if not turned:
            break
    sizes = np.sqrt((a**2).sum(1))
    order = np.argsort(-sizes, kind="stable")
    v = v[order] / np.sqrt((v[order] ** 2).sum(1, keepdims=True))
    at = np.abs(v).argmax(1)
    return v * np.where(v[np.arange(width), at] < 0, -1.0, 1.0)[:, None], sizes[order]


def fit(good: DataFrame, width: int, most: int = COMPONENTS) -> Fit:
    """Means, components and deviations of the rows of numbers()."""
    n, sums = column_sums(good, width) if width else (0, [])
    if n < 2:
        return Fit(n, sums, np.zeros((0, width)), np.zeros(0), np.zeros(0))
    v, sizes = jacobi(tsqr(good, n, sums))
    keep = min(most, int((sizes > FLAT * sizes[0]).sum()))
    return Fit(n, sums, v[:keep], sizes[:keep] / math.sqrt(n), sizes[:keep] ** 2 / max((sizes**2).sum(), 5e-324))


def project(centred: np.ndarray, model: Fit) -> np.ndarray:
    return centred @ model.components.T / model.deviations


def moments(parts: list[np.ndarray], k: int) -> np.ndarray:
    """(n, means, centred products) of parts together, pairwise: products are only ever of centred numbers."""
    n, mean, m = 0.0, np.zeros(k), np.zeros((k, k))
    for p in parts:
        pn, pm, pc = p[0], p[1 : k + 1], p[k + 1 :].reshape(k, k)
        d, all_n = pm - mean, n + pn
        m = m + pc + np.outer(d, d) * (n * pn / all_n)
        mean, n = mean + d * (pn / all_n), all_n
    return np.concatenate([[n], mean, m.ravel()])


def identity_error(good: DataFrame, model: Fit) -> float | None:
    """The largest entry, by size, of the whitened rows' covariance minus the identity."""
    k, n, sums, width = len(model.deviations), model.n, model.sums, model.width
    if not k:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, part = None, None
        for b in batches:
            if not b.num_rows:
                continue
            part = b.column("part")[0].as_py() if part is None else part
            w = project(from_mean(whole(b, width), n, sums)[1], model)
            mean = w.mean(0)
            here = np.concatenate([[len(w)], mean, ((w - mean).T @ (w - mean)).ravel()])
            done = here if done is None else moments([done, here], k)
        if done is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "value": pa.array([done], pa.list_(pa.float64()))})

    leaves = good.select(F.spark_partition_id().cast("long").alias("part"), "_x").mapInArrow(run, "part long, value array<double>")
    got = fold(leaves, lambda parts: moments(parts, k), (k + 1) * (k + 1))
    return float(np.abs(got[k + 1 :].reshape(k, k) / got[0] - np.eye(k)).max())


def deviations(d: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """The sums of (n * x - S) ** 2, exact; null where 64 bits do not hold one."""
    rest = [s % n for s in sums]
    if len(d) and math.sqrt(d.shape[1]) * n * (float(np.abs(d).max()) + 1) < 2.0**31:
        return pa.array(((n * d - np.array(rest, np.int64)) ** 2).sum(1), pa.int64())
    wide = ((n * d.astype(object) - np.array(rest, object)) ** 2).sum(1)
    return pa.array([int(v) if v < 1 << 63 else None for v in wide], pa.int64())


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """A row for each row and component: key, component, n, deviation, whitened, explained, identity_error."""
    python_batches(vectors.sparkSession)
    vectors = vectors.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{vector}`").alias("_vector"))
    good, width = numbers(vectors, "_vector")
    model = fit(good, width, most)
    error, n, sums, k = identity_error(good, model), model.n, model.sums, len(model.deviations)
    kind = vectors.schema["_key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows or not k:
                continue
            d, centred = from_mean(whole(b, width), n, sums)
            at = pa.array(np.repeat(np.arange(len(d)), k))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(d))), pa.array(np.full(len(at), n, np.int64)), deviations(d, n, sums).take(at),
                    pa.array(project(centred, model).ravel()), pa.array(np.tile(model.explained, len(d))), pa.array(np.full(len(at), error)),
                ],
                names=["_key", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    out = good.select("_key", "_x").mapInArrow(run, f"_key {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return out.withColumnRenamed("_key", key)
