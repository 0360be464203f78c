import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import whitening as wh
from skein.llm.common import table

KIND = "vec_id long, embedding array<float>, label int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], KIND)


def plain(rows, most=wh.COMPONENTS):
    """Whole numbers, and covariance, eigenvalues and components by a dense solver."""
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    dev = [sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]
    centred = np.array([[(n * c - s) / n for c, s in zip(v, sums, strict=True)] for v in x])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    return n, dev, centred, e[::-1][:most], v[:, ::-1][:, :most], e.sum()


def check(df, rows, ids=None, most=wh.COMPONENTS):
    n, dev, centred, e, v, trace = plain(rows, most)
    got = wh.whiten(df, most=most).collect()
    assert len(got) == n * len(e)
    by = {(r.vec_id, r.component): r for r in got}
    error = got[0].identity_error
    assert 0 <= error <= 1e-9 and {r.identity_error for r in got} == {error} and {r.n for r in got} == {n}
    for c in range(1, len(e) + 1):
        mine = np.array([by[i, c].whitened for i in ids or range(n)])
        want = centred @ v[:, c - 1] / math.sqrt(e[c - 1])
        assert min(abs(mine - want).max(), abs(mine + want).max()) < 1e-6, c
        assert by[(ids or [0])[0], c].explained == pytest.approx(e[c - 1] / trace, rel=1e-9)
    assert [by[i, 1].deviation for i in ids or range(n)] == dev


def test_table_against_dense_solver(spark, sf):
    df = table(spark, sf, "embeddings")
    rows = sorted((r.vec_id, r.embedding) for r in df.collect())
    check(df.repartition(7), [v for _, v in rows], [i for i, _ in rows])


def test_small_and_odd_dimensions(spark):
    rng = np.random.default_rng(3)
    for width in (1, 2, 5, 33):
        rows = (rng.normal(size=(70, width)) * np.linspace(20, 1, width)).astype(np.float32).tolist()
        check(vectors(spark, enumerate(rows)), rows)
    check(vectors(spark, enumerate(rows)), rows, most=3)


def test_jacobi_keeps_small_deviations():
    rng = np.random.default_rng(5)
    q1, q2 = np.linalg.qr(rng.normal(size=(200, 12)))[0], np.linalg.qr(rng.normal(size=(12, 12)))[0]
    sizes = 10.0 ** -np.arange(12)
    r = wh.triangle([(q1 * sizes) @ q2.T], 12)
    v, got = wh.jacobi(r)
    assert np.allclose(got, sizes, rtol=1e-4, atol=1e-15) and np.allclose(v @ v.T, np.eye(12), atol=1e-14)
    assert sorted((p, q) for round_ in wh.pairings(7) for p, q in zip(*(np.sort(np.stack(round_), axis=0)), strict=True)) == [(i, j) for i in range(7) for j in range(i + 1, 7)]


def test_tree_of_many_parts(spark):
    """Triangles and moments of more parts than one group takes equal those of all rows together."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 6)) * [9, 5, 3, 1, 1, 0.5]
    parts = spark.createDataFrame([(i, x[i : i + 1].ravel().tolist()) for i in range(400)], "part long, value array<double>")
    r = wh.fold(parts, lambda some: wh.triangle(some, 6), 36).reshape(6, 6)
    assert np.allclose(r.T @ r, x.T @ x)
    leaf = lambda y: np.concatenate([[len(y)], y.mean(0), ((y - y.mean(0)).T @ (y - y.mean(0))).ravel()])
    assert np.allclose(wh.moments([leaf(x[:1]), leaf(x[1:250]), leaf(x[250:])], 6), leaf(x))


def test_rows_that_cannot_take_part(spark):
    nan, inf = float("nan"), float("inf")
    good = [[0.5, 1.25], [2.0, -3.5], [7.0, 0.0], [1.0, 1.0]]
    bad = [None, [], [1.0, None], [nan, 1.0], [inf, 0.0], [1e30, 0.0], [1.0], [1.0, 2.0, 3.0]]
    df = vectors(spark, [(i, v) for i, v in enumerate(good + bad)])
    check(df, good)
    assert {r.vec_id for r in wh.whiten(df).collect()} == {0, 1, 2, 3}


def test_flat_repeated_and_empty(spark):
    assert wh.whiten(vectors(spark, [])).count() == 0 and wh.whiten(vectors(spark, [(1, [1.0, 2.0])])).count() == 0
    assert wh.whiten(vectors(spark, [(i, [1.0, 2.0]) for i in range(5)])).count() == 0
    got = wh.whiten(vectors(spark, [(i, [float(i), 4.0, 2.0 * i]) for i in range(5)])).collect()  # one direction only
    assert {r.component for r in got} == {1} and len(got) == 5
    got = wh.whiten(vectors(spark, [(None, [1.0, 0.0]), (3, [0.0, 2.0]), (3, [0.0, 2.0]), (4, [5.0, 1.0])])).collect()
    assert len(got) == 8 and sum(r.vec_id is None for r in got) == 2 and sum(r.vec_id == 3 for r in got) == 4
    assert wh.whiten(vectors(spark, [(i, None) for i in range(3)])).count() == 0


def test_deviation_beyond_64_bits(spark):
    got = {r.vec_id: r.deviation for r in wh.whiten(vectors(spark, [(0, [0.0]), (1, [1e14]), (2, [64.0])]).select("vec_id", "embedding")).collect()}
    assert got[1] is None and got[0] is None  # far from the mean
    near = {r.vec_id: r.deviation for r in wh.whiten(vectors(spark, [(i, [float(i) * 1e5]) for i in range(3)])).collect()}
    x = [math.floor(64 * i * 1e5) + 1_000_000 for i in range(3)]
    assert near == {i: (3 * x[i] - sum(x)) ** 2 for i in range(3)}


def test_other_columns_and_kinds(spark):
    rows = np.random.default_rng(1).normal(size=(20, 3))
    df = spark.createDataFrame([(f"v{i}", v.tolist(), 1, 2) for i, v in enumerate(rows)], "`id.x` string, embedding array<double>, part int, _x int")
    got = wh.whiten(df, key="id.x").collect()
    assert len(got) == 60 and got[0].__fields__[0] == "id.x"
    assert wh.whiten(df.withColumn("embedding", F.col("embedding").cast("array<float>")), key="id.x").count() == 60
