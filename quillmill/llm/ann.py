"""Approximate nearest neighbours: stable projections in a kd-tree, verified until a chi-square test stops.

A Gaussian (2-stable) projection to DIMS dimensions turns a pair at distance d into one whose
squared projected distance is d^2 times a chi-square variable of DIMS degrees. So once the
next projected neighbour is at squared distance r^2 >= q d_k^2, with d_k the k-th best distance
so far and q the chi-square quantile of CONFIDENCE, a true neighbour not yet verified is less
likely than 1 - CONFIDENCE, and the search ends (the SRS method of Sun et al., with an
approximation ratio of 1: any higher one stops earlier than recall allows).

The top of the kd-tree, fitted on a sample of projections, cuts all points into cells of about
CELL; the sample moves borders alone, never results. A query searches its own cell first, then
the other cells in the order of their boxes' projected distance, one, two, four and so on a round,
for as long as that distance is within the stopping radius, which shrinks from round to round. The cells
are found by descent: subtrees out of reach are never entered. A task streams queries past one cell's points.
Within a cell the tree's leaves are taken in order of projected distance for a group of neighbouring
queries, so verification is a matrix product. Every row is a query.

Of equal vectors, only the k + 1 first are points of the tree: the others are nobody's neighbours but by ties, and their own
neighbours are those first ones. So no number of copies swells a cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import ceil, exp, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.llm.common import bound_batches, fraction, stash, table

K, DIMS, CONFIDENCE, LEAF, CELL, SEED = 10, 8, 0.9, 64, 16_384, 29
SAMPLE_PER_CELL = 64
#: Queries that take a cell's leaves together, and that a task descends with at a time.
GROUP, CHUNK = 256, 256


def chi_square(x: float, m: int) -> float:
    """Distribution function for an even number of degrees m."""
    term, total = 1.0, 0.0
    for i in range(m // 2):
        total += term
        term *= x / 2 / (i + 1)
    return 1 - exp(-x / 2) * total


def quantile(p: float, m: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square(mid, m) < p else (lo, mid)
    return hi


def _matrix(a: pa.Array, d: int) -> np.ndarray:
    return a.flatten().to_numpy(zero_copy_only=False).reshape(len(a), d).astype(np.float32)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel(), kind))


@dataclass
class Top:
    """The upper levels as a heap: node i splits dimension dim[i] at cut[i]; cells are numbered left to right."""

    depth: int
    dim: np.ndarray
    cut: np.ndarray

    def cell(self, y: np.ndarray) -> np.ndarray:
        at = np.zeros(len(y), np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + (y[np.arange(len(y)), self.dim[at]] > self.cut[at])
        return at - (2**self.depth - 1)

    def reach(self, y: np.ndarray, radius2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, cell and squared distance of the cell's box, for all cells whose box comes as near as the row's radius."""
        first = 2**self.depth - 1
        rows, cells, far = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        stack = [(0, np.arange(len(y)), np.zeros(len(y)), np.zeros(y.shape))]
        while stack:
            node, who, dist, gap = stack.pop()
            if node >= first:
                rows.append(who)
                cells.append(np.full(len(who), node - first))
                far.append(dist)
                continue
            d = self.dim[node]
            over = y[who, d].astype(np.float64) - self.cut[node]
            across = dist - gap[:, d] ** 2 + over**2
            for child, near in ((2 * node + 1, over <= 0), (2 * node + 2, over > 0)):
                to = np.where(near, dist, across)
                keep = to <= radius2[who]
                if keep.any():
                    new = gap[keep]
                    new[:, d] = np.where(near[keep], new[:, d], over[keep])
                    stack.append((child, who[keep], to[keep], new))
        return np.concatenate(rows), np.concatenate(cells), np.concatenate(far)

    def following(self, y: np.ndarray, radius2: np.ndarray, done: np.ndarray, step: int) -> list[np.ndarray]:
        """For each row, the next step cells after the done ones among those in reach other than its own, nearest first.

        The order is fixed, and a radius that shrinks only takes cells from its end, so a count says which were visited.
        """
        home, out = self.cell(y), []
        for a in range(0, len(y), CHUNK):
            part = slice(a, a + CHUNK)
            row, cell, far = self.reach(y[part], radius2[part])
            other = cell != home[part][row]
            row, cell, far = row[other], cell[other], far[other]
            order = np.lexsort((cell, far, row))
            row, cell = row[order], cell[order]
            start = np.searchsorted(row, np.arange(len(y[part]) + 1))
            out += [cell[min(i + d, j) : min(i + d + step, j)] for i, j, d in zip(start[:-1], start[1:], done[part], strict=True)]
        return out


def split(y: np.ndarray, depth: int) -> Top:
    n = 2**depth
    dim, cut = np.zeros(max(n - 1, 1), np.int64), np.zeros(max(n - 1, 1), np.float32)
    part = {0: y}
    for i in range(n - 1):
        here = part.pop(i)
        if len(here):
            dim[i] = np.argmax(here.max(0) - here.min(0))
            cut[i] = np.median(here[:, dim[i]])
        right = here[:, dim[i]] > cut[i]
        part[2 * i + 1], part[2 * i + 2] = here[~right], here[right]
    return Top(depth, dim, cut)


def leaves(y: np.ndarray, size: int) -> list[np.ndarray]:
    done, todo = [], [np.arange(len(y))]
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            done.append(rows)
            continue
        d = np.argmax(y[rows].max(0) - y[rows].min(0))
        half = len(rows) // 2
        rows = rows[np.argpartition(y[rows, d], half)]
        todo += [rows[half:], rows[:half]]
    return done


class Points:
    """A cell's points (vectors x, projections y, ids) by leaves."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ids: np.ndarray) -> None:
        parts = leaves(y, LEAF)
        self.order = np.concatenate(parts)
        self.x, self.ids = x[self.order], ids[self.order]
        self.ends = np.cumsum([len(p) for p in parts])
        self.starts = self.ends - [len(p) for p in parts]
        self.lo, self.hi = np.array([y[p].min(0) for p in parts]), np.array([y[p].max(0) for p in parts])
        self.norm = (self.x * self.x).sum(1)


def search(points: Points, qx: np.ndarray, qy: np.ndarray, qid: np.ndarray, bound: np.ndarray, k: int, q: float) -> tuple[np.ndarray, np.ndarray]:
    """Places among points and squared distances of up to k neighbours of each query, -1 and inf where there are fewer.

    bound: the k-th squared distance known beforehand. A point whose id is the query's isn't its own neighbour.
    """
    n, p = len(qx), points
    best_d, best_i = np.full((n, k), np.inf, np.float32), np.full((n, k), -1, np.int64)
    own = (qx * qx).sum(1)
    for rows in leaves(qy, GROUP) if n else []:
        near = np.zeros((len(rows), len(p.lo)), np.float32)
        for d in range(qy.shape[1]):
            v = qy[rows, d][:, None]
            near += np.maximum(np.maximum(p.lo[:, d] - v, v - p.hi[:, d]), 0) ** 2
        turn = np.argsort(near.min(0), kind="stable")
        near = near[:, turn]
        left = np.minimum.accumulate(near[:, ::-1], axis=1)[:, ::-1]  # the least distance of this leaf and all after it
        live, at, step = np.arange(len(rows)), 0, 4
        while at < len(turn):
            kth = np.minimum(best_d[rows[live], -1], bound[rows[live]])
            open_ = left[live, at] < q * kth
            live, kth = live[open_], kth[open_]
            if not len(live):
                break
            cols = np.concatenate([np.arange(p.starts[c], p.ends[c]) for c in turn[at : at + step]])
            r = rows[live]
            part = (-2 * qx[r]) @ p.x[cols].T
            part += p.norm[cols]  # squared distances less the query's own square
            a, b = np.nonzero(part < (kth - own[r])[:, None])
            other = p.ids[cols[b]] != qid[r[a]]
            a, b = a[other], b[other]
            if len(a):
                who, first, count = np.unique(a, return_index=True, return_counts=True)
                d, i = np.full((len(who), k + count.max()), np.inf, np.float32), np.full((len(who), k + count.max()), -1, np.int64)
                d[:, :k], i[:, :k] = best_d[r[who]], best_i[r[who]]
                row = np.repeat(np.arange(len(who)), count)
                col = k + np.arange(len(a)) - np.repeat(first, count)
                d[row, col], i[row, col] = np.maximum(part[a, b] + own[r[a]], 0), cols[b]
                pick = np.argpartition(d, k - 1, axis=1)[:, :k]
                pick = np.take_along_axis(pick, np.argsort(np.take_along_axis(d, pick, 1), axis=1, kind="stable"), 1)
                best_d[r[who]], best_i[r[who]] = np.take_along_axis(d, pick, 1), np.take_along_axis(i, pick, 1)
            at += step
            step = min(2 * step, 64)
    best_i[~np.isfinite(best_d)] = -1
    return np.where(best_i >= 0, p.order[best_i], -1), best_d


_FOUND = "array<struct<d:double,v:long,r:long>>"
_BLOCK = 4096


@dataclass
class Part:
    """Rows of points or queries: id, whose vec_id is null where has is false, vector, projection."""

    r: np.ndarray
    item: np.ndarray
    has: np.ndarray
    x: np.ndarray
    y: np.ndarray
    kth: np.ndarray


def _part(b: pa.RecordBatch, d: int) -> Part:
    item = b.column("vec_id")
    kth = b.column("kth").to_numpy() if "kth" in b.schema.names else np.full(b.num_rows, np.inf, np.float32)
    return Part(b.column("r").to_numpy(), item.fill_null(0).to_numpy(), ~np.asarray(item.is_null()), _matrix(b.column("x"), d), _matrix(b.column("y"), DIMS), kth)


def _join(parts: list[Part]) -> Part:
    return Part(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("r", "item", "has", "x", "y", "kth")))


def _found(place: np.ndarray, p: Part, qx: np.ndarray) -> pa.Array:
    """Lists of (distance, vec_id, row), with distances taken again in full precision."""
    q, j = np.nonzero(place >= 0)
    at = place[q, j]
    dist = np.sqrt(((p.x[at].astype(np.float64) - qx[q].astype(np.float64)) ** 2).sum(1))
    off = np.searchsorted(q, np.arange(len(place) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.StructArray.from_arrays([pa.array(dist), pa.array(p.item[at], mask=~p.has[at]), pa.array(p.r[at])], ["d", "v", "r"]))


def _runs(batches: Iterator[pa.RecordBatch], *by: str) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Runs of equal keys of each batch."""
    for b in batches:
        if b.num_rows:
            keys = np.column_stack([b.column(c).to_numpy() for c in by])
            edges = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1), True])
            for x, y in zip(edges[:-1], edges[1:], strict=True):
                yield tuple(keys[x].tolist()), b.slice(x, y - x)


def _home(d: int, k: int, q: float):
    """Each point with its neighbours within its own cell; rows come sorted by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(held: list[Part]) -> Iterator[pa.RecordBatch]:
            if not held:
                return
            p = _join(held)
            points = Points(p.x, p.y, p.r)
            # Blocks of neighbours, so that groups of queries are near each other.
            for rows in leaves(p.y, _BLOCK):
                place, _ = search(points, p.x[rows], p.y[rows], p.r[rows], p.kth[rows], k, q)
                cols = [pa.array(p.r[rows]), pa.array(p.item[rows], mask=~p.has[rows]), _lists(p.x[rows], pa.float32()), _lists(p.y[rows], pa.float32()), _found(place, p, p.x[rows])]
                yield pa.RecordBatch.from_arrays(cols, ["r", "vec_id", "x", "y", "found"])

        cell, held = None, []
        for (c,), b in _runs(batches, "cell"):
            if c != cell:
                yield from close(held)
                cell, held = c, []
            held.append(_part(b, d))
        yield from close(held)

    return run


def _visit(d: int, k: int, q: float):
    """r, found of queries in a cell other than their own; rows come sorted by cell and copy, points before queries.

    Queries stream past the points, so a task holds one cell and a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, p, points = None, [], None, None
        for (*cell, kind), b in _runs(batches, "cell", "copy", "kind"):
            if cell != at:
                at, held, points = cell, [], None
            if kind == 0:
                held.append(_part(b, d))
                continue
            if points is None and held:
                p = _join(held)
                points = Points(p.x, p.y, p.r)
            if points is not None:
                asks = _part(b, d)
                place, _ = search(points, asks.x, asks.y, asks.r, asks.kth, k, q)
                yield pa.RecordBatch.from_arrays([b.column("r"), _found(place, p, asks.x)], ["r", "found"])

    return run


def _unlike(points: DataFrame, k: int) -> tuple[DataFrame, DataFrame | None]:
    """points without the copies of a vector past the first k + 1 by vec_id, and the finished rows of those copies, if there are any."""
    keys = points.select("r", "vec_id", F.xxhash64("x").alias("h"), F.xxhash64(F.lit(1), "x").alias("g"))
    hot = stash(keys.groupBy("h", "g").count().where(F.col("count") > k + 1).select("h", "g"))
    if not hot.head(1):
        return points, None
    copies = keys.join(hot, ["h", "g"])
    nth = F.row_number().over(Window.partitionBy("h", "g").orderBy("vec_id", "r"))
    first = stash(copies.withColumn("nth", nth).where(F.col("nth") <= k + 1).drop("nth"))
    lists = first.groupBy("h", "g").agg(F.slice(F.array_sort(F.collect_list(F.struct("vec_id", "r"))), 1, k).alias("f"))
    rest = copies.join(first.select("r"), "r", "left_anti")
    done = rest.join(lists, ["h", "g"]).select("vec_id", F.col("f.vec_id").alias("neighbors"), F.transform("f", lambda _: F.lit(0.0)).alias("distances"))
    return points.join(rest.select("r"), "r", "left_anti"), done


def neighbours(vectors: DataFrame, k: int = K, confidence: float = CONFIDENCE, cell: int = CELL, seed: int = SEED) -> DataFrame:
    """vec_id, neighbors, distances for each row of vectors (vec_id, embedding, ...): up to k nearest other rows.

    Euclidean, nearest first, ties by vec_id, null first; of rows equally far at the k-th place, any. Defined results: the dimension is the commonest length of
    an embedding (the least, if several are); a null embedding, one of another length or with a
    null, NaN or infinite entry is nobody's neighbour and has empty lists; repeated rows are
    neighbours of each other at distance 0, however many there are; a null vec_id is carried as null; fewer than k other
    rows give shorter lists; an empty table gives an empty result; other columns play no part.
    """
    rows = bound_batches(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    big = 1e18  # beyond it squares leave the single precision range
    fine = F.coalesce(F.forall("x", lambda e: F.coalesce(e.between(-big, big) & ~F.isnan(e), F.lit(False))), F.lit(False)) & (F.size("x") > 0)
    sizes = rows.where(fine).groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = sizes.d if sizes else 1
    good = fine & (F.size("x") == d)
    none = rows.where(~F.coalesce(good, F.lit(False))).select("vec_id", F.expr("cast(array() as array<long>) neighbors"), F.expr("cast(array() as array<double>) distances"))
    projection = np.random.default_rng(seed).normal(size=(d, DIMS)).astype(np.float32)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("x"), d)
            yield pa.RecordBatch.from_arrays([b.column("r"), b.column("vec_id"), _lists(x, pa.float32()), _lists(x @ projection, pa.float32())], ["r", "vec_id", "x", "y"])

    every = stash(rows.where(good).select(F.monotonically_increasing_id().alias("r"), "vec_id", "x").mapInArrow(project, "r long, vec_id long, x array<float>, y array<float>"))
    points, copies = _unlike(every, k)
    n = every.count()
    depth = max(0, ceil(log2(max(n, 1) / cell)))
    share = min(1.0, SAMPLE_PER_CELL * 2**depth / max(n, 1))
    sample = points.where(fraction("r", seed=seed) < share).select("y").toArrow()  # about SAMPLE_PER_CELL * DIMS numbers a cell
    top = split(_matrix(sample.column("y").combine_chunks(), DIMS) if len(sample) else np.zeros((0, DIMS), np.float32), depth)
    sent = points.sparkSession.sparkContext.broadcast((depth, top.dim, top.cut))  # plain arrays: a broadcast names its classes, and executors have no copy of this package
    q = quantile(confidence, DIMS)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(Top(*sent.value).cell(_matrix(b.column("y"), DIMS)).astype(np.int32)), *b.columns], ["cell", *b.schema.names])

    def plan(step: int):
        """visit: the next step cells of a query, none if it is done; what it has visited before."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                kth = b.column("kth").to_numpy()
                done = b.column("done").to_numpy()
                cells = Top(*sent.value).following(_matrix(b.column("y"), DIMS), q * kth.astype(np.float64), done, step)
                count = np.array([len(c) for c in cells], np.int32)
                visit = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)].astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int64), *cells]).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("r", "vec_id", "x", "y", "found", "kth")), pa.array(done + count), visit], ["r", "vec_id", "x", "y", "found", "kth", "done", "visit"])

        return lambda state: state.mapInArrow(run, f"r long, vec_id long, x array<float>, y array<float>, found {_FOUND}, kth float, done int, visit array<int>")

    placed = points.mapInArrow(place, "cell int, r long, vec_id long, x array<float>, y array<float>")
    last = F.element_at("found", k)["d"]
    kth = F.when(F.size("found") >= k, last * last).otherwise(F.lit(float("inf"))).cast("float").alias("kth")
    state = placed.repartition("cell").sortWithinPartitions("cell").mapInArrow(_home(d, k, q), f"r long, vec_id long, x array<float>, y array<float>, found {_FOUND}")
    state = state.select("*", F.lit(0).alias("done")).select("*", kth)
    ended, step = [], 1
    while True:
        state = stash(plan(step)(state))
        ended.append(state.where(F.size("visit") == 0).select("vec_id", "found"))
        asked = state.agg(F.coalesce(F.sum(F.size("visit")), F.lit(0))).first()[0]
        if not asked:
            break
        # Each cell in so many copies that a task sees about four queries of each point.
        copies_of = max(1, ceil(asked / (2**depth * 4 * cell)))
        asks = state.select(F.explode("visit").alias("cell"), F.pmod(F.xxhash64("r"), F.lit(copies_of)).cast("int").alias("copy"), F.lit(1).alias("kind"), "r", "vec_id", "x", "y", "kth")
        there = placed.select("cell", F.explode(F.sequence(F.lit(0), F.lit(copies_of - 1))).alias("copy"), F.lit(0).alias("kind"), "r", "vec_id", "x", "y", F.lit(float("inf")).cast("float").alias("kth"))
        met = there.unionByName(asks).repartition("cell", "copy").sortWithinPartitions("cell", "copy", "kind").mapInArrow(_visit(d, k, q), f"r long, found {_FOUND}")
        open_ = state.where(F.size("visit") > 0)
        both = open_.select("r", "vec_id", "x", "y", "done", "found").unionByName(met, allowMissingColumns=True)
        state = both.groupBy("r").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("vec_id", "x", "y", "done")], F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k).alias("found")).select("*", kth)
        step *= 2
    whole = reduce(DataFrame.unionByName, ended).select("vec_id", F.col("found.v").alias("neighbors"), F.col("found.d").alias("distances")).unionByName(none)
    return whole if copies is None else whole.unionByName(copies)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"))
