"""Nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.llm import ann as A


def brute(x, k):
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, axis=1, kind="stable")[:, :k], np.sqrt(np.sort(d, axis=1)[:, :k])


def test_chi_square():
    assert A.chi_square(15.507, 8) == pytest.approx(0.95, abs=1e-4) and A.quantile(0.95, 8) == pytest.approx(15.507, abs=1e-3)
    rng = np.random.default_rng(0)
    assert (rng.normal(size=(200_000, 6)) ** 2).sum(1).__le__(7.0).mean() == pytest.approx(A.chi_square(7.0, 6), abs=0.005)


def boxes(top):
    """Bounds of the cells, from the cuts."""
    n = 2**top.depth
    lo, hi = np.full((2 * n, 8), -np.inf), np.full((2 * n, 8), np.inf)
    for i in range(n - 1):
        for child in (2 * i + 1, 2 * i + 2):
            lo[child], hi[child] = lo[i], hi[i]
        hi[2 * i + 1, top.dim[i]] = lo[2 * i + 2, top.dim[i]] = top.cut[i]
    return lo[n - 1 : 2 * n - 1], hi[n - 1 : 2 * n - 1]


def test_descent_finds_the_cells_in_reach():
    rng = np.random.default_rng(1)
    y = (rng.normal(size=(700, 3)) @ rng.normal(size=(3, 8))).astype(np.float32)
    top = A.split(y[:300], 5)
    lo, hi = boxes(top)
    cell = top.cell(y)
    assert ((y >= lo[cell]) & (y <= hi[cell])).all() and len(set(cell.tolist())) == 32
    radius = rng.random(700) * 4
    gap = np.maximum(np.maximum(lo[None] - y[:, None], y[:, None] - hi[None]), 0)
    want = (gap**2).sum(2)
    row, at, far = top.reach(y, radius)
    assert set(zip(row.tolist(), at.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(want <= radius[:, None])), strict=True))
    assert np.allclose(far, want[row, at], atol=1e-4)
    # All rounds together visit every cell in reach but one's own, nearest first.
    done, seen = np.zeros(700, np.int64), [[] for _ in range(700)]
    for step in (1, 2, 4, 8, 16, 32):
        for i, c in enumerate(top.following(y, radius, done, step)):
            seen[i] += c.tolist()
            done[i] += len(c)
    for i in range(700):
        assert sorted(seen[i]) == [c for c in np.flatnonzero(want[i] <= radius[i]) if c != cell[i]]
        assert np.all(np.diff(want[i][seen[i]]) >= -1e-4)


def test_search_is_exact_without_a_stop():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 16)).astype(np.float32)
    y = x[:, :8].copy()
    at, d = A.search(A.Points(x, y, np.arange(700)), x, y, np.arange(700), np.full(700, np.inf, np.float32), 5, np.inf)
    want, dist = brute(x.astype(float), 5)
    assert np.allclose(np.sqrt(d), dist, atol=1e-3) and (at == want).mean() > 0.99


@pytest.mark.parametrize("cell", [16_384, 120])
def test_whole_query_recall(spark, sf, cell):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = vectors.orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], float)
    ids = [r.vec_id for r in rows]
    want, dist = brute(x, A.K)
    got = {r.vec_id: r for r in A.neighbours(vectors, cell=cell).collect()}
    assert sorted(got) == ids
    recall = np.mean([len(set(got[v].neighbors) & {ids[j] for j in want[i]}) / A.K for i, v in enumerate(ids)])
    assert recall >= 0.9
    for i, v in enumerate(ids):
        assert v not in got[v].neighbors and got[v].distances == sorted(got[v].distances)
        assert got[v].distances[0] >= dist[i][0] - 1e-6


def test_recall_where_few_cells_are_visited(spark):
    """Vectors of few inner dimensions: queries stop, after a part of the cells, with recall."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 3)) @ rng.normal(size=(3, 24)) + 0.01 * rng.normal(size=(3000, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.neighbors for r in A.neighbours(df, cell=60).collect()}
    want, _ = brute(x, A.K)
    assert np.mean([len(set(got[i]) & set(want[i].tolist())) / A.K for i in range(3000)]) >= 0.9


def test_very_many_equal_vectors(spark):
    """100,000 copies with small cells: in time, and each copy has the first others for neighbours."""
    some = [(200_000 + i, [float(i), 1.0, -float(i)]) for i in range(40)]
    same = spark.range(100_000).select(F.col("id").alias("vec_id"), F.array(F.lit(0.5), F.lit(0.5), F.lit(0.5)).cast("array<float>").alias("embedding"))
    df = same.unionByName(spark.createDataFrame(some, "vec_id long, embedding array<float>"))
    got = A.neighbours(df, k=3, cell=64)
    by = {r.vec_id: r for r in got.where("vec_id < 5 or vec_id > 99995").collect()}
    assert by[0].neighbors == [1, 2, 3] and by[2].neighbors == [0, 1, 3] and by[3].neighbors == by[99_999].neighbors == [0, 1, 2]
    assert by[99_999].distances == [0.0, 0.0, 0.0] and by[200_000].neighbors[0] in (0, 1, 200_001) and got.count() == 100_040


def test_cases(spark):
    rows = [(i, [float(i), 0.0, 1.0]) for i in range(20)]
    rows += [(3, [3.0, 0.0, 1.0]), (None, [100.0, 0.0, 1.0]), (50, None), (51, [1.0]), (52, [1.0, None, 2.0]), (53, [float("nan"), 0.0, 0.0]), (54, [float("inf"), 0.0, 0.0]), (55, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for c in ("r", "x", "y", "cell", "found", "neighbors", "distances"):
        df = df.withColumn(c, F.lit("mine"))
    got = A.neighbours(df, k=3, cell=8).collect()
    assert len(got) == len(rows)
    by = {r.vec_id: r for r in got}
    assert all(by[i].neighbors == [] and by[i].distances == [] for i in range(50, 56))
    threes = [r for r in got if r.vec_id == 3]
    assert all(r.neighbors[0] == 3 and r.distances[0] == 0 for r in threes) and len(threes) == 2
    assert by[10].neighbors[:2] == [9, 11] and by[None].neighbors == [19, 18, 17]
    few = spark.createDataFrame(rows[:2], "vec_id long, embedding array<float>")
    assert sorted((r.vec_id, r.neighbors) for r in A.neighbours(few).collect()) == [(0, [1]), (1, [0])]
    assert A.neighbours(df.limit(0)).count() == 0
