"""Shards of exact sizes holding a uniform shuffle, by a hypergeometric communication matrix.

With n_p rows in input partition p and group g to hold m_g rows, the number of rows that p sends
to g in a uniform shuffle is a draw of the matrix with these margins. Each partition permutes its
rows, sends runs of the drawn lengths, and each group permutes what came: one exchange. A group is
what one task permutes, GROUP_ROWS rows or so: it is a shard, or several small shards, of which each
is a run of the group's permutation, or one of the equal parts of a large shard. So the matrix has as
many columns as there are groups, however small the shards are.

The matrix is never held anywhere. Rows of it are drawn by halving the partitions recursively,
each node splitting its column totals by a multivariate hypergeometric draw seeded by the node's
place, so a task finds its own row in log2(partitions) vectorised draws from the row counts alone.

The keys of both permutations are hashes of (seed, stream, partition, row). A hash of a 64-bit number
is a bijection for a given seed and stream, so keys never tie.

Sizes stay exact when executors are lost: all randomness is drawn over a table scan, whose
partitions come back the same, and a row past its partition's count fails the job. A plan that
isn't a plain scan is first written out by checkpoint().
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, lgamma, log, log1p, pi, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.llm.common import free_name, steady, table

SHARD_ROWS, GROUP_ROWS, SEED = 65_536, 65_536, 17
#: What numpy's generator takes for either colour.
_LIMIT = 10**9 - 1


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    """As even as can be: sizes differ by one at most."""
    return rows // shards + (np.arange(shards) < rows % shards)


def group_sizes(rows: int, shards: int, group_rows: int = GROUP_ROWS) -> np.ndarray:
    """Sizes of the groups in order: runs of whole shards, or even parts of a shard each."""
    groups = max(1, -(-rows // group_rows))
    if shards >= groups:
        ends = np.r_[0, np.cumsum(shard_sizes(rows, shards))]
        return np.diff(ends[np.arange(groups + 1) * shards // groups])
    parts = -(-groups // shards)
    sizes = shard_sizes(rows, shards)[:, None]
    return (sizes // parts + (np.arange(parts)[None] < sizes % parts)).ravel()


def matrix_row(counts: np.ndarray, sizes: np.ndarray, p: int, seed: int = SEED) -> np.ndarray:
    """Row p of the matrix with margins counts and sizes; all rows together have exactly these margins."""
    total = np.r_[0, np.cumsum(np.asarray(counts, np.int64))]
    lo, hi, columns, node = 0, len(counts), np.asarray(sizes, np.int64), 1
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = _draw(np.random.default_rng([seed, node]), columns, int(total[mid] - total[lo]))
        if p < mid:
            hi, columns, node = mid, left, 2 * node
        else:
            lo, columns, node = mid, columns - left, 2 * node + 1
    return columns


def _draw(rng: np.random.Generator, colors: np.ndarray, n: int) -> np.ndarray:
    """Multivariate hypergeometric by halving the colours, a level of the tree at a time. Colours of no balls take no time."""
    some = np.flatnonzero(colors)
    out = np.zeros(len(colors), np.int64)
    if not len(some) or not n:
        return out
    levels = [colors[some]]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append(np.add.reduceat(last, np.arange(0, len(last), 2)))
    take = np.array([n], np.int64)
    for below in reversed(levels[:-1]):
        left, right = below[0::2], np.zeros(len(take), np.int64)
        right[: len(below) // 2] = below[1::2]
        got = np.minimum(take, left)  # where there is no choice
        open_ = np.flatnonzero((take > 0) & (right > 0) & (take < left + right))
        got[(take > 0) & (take == left + right)] = left[(take > 0) & (take == left + right)]
        big = (left[open_] > _LIMIT) | (right[open_] > _LIMIT)
        at = open_[~big]
        got[at] = rng.hypergeometric(left[at], right[at], take[at])
        for i in open_[big]:
            got[i] = _hyper(rng, int(left[i]), int(right[i]), int(take[i]))
        both = np.empty(2 * len(take), np.int64)
        both[0::2], both[1::2] = got, take - got
        take = both[: len(below)]
    out[some] = take
    return out


def _stirling(n: float) -> float:
    """log n! less Stirling's formula, to full relative precision (Loader's series)."""
    if n < 16:
        return lgamma(n + 1) - (n + 0.5) * log(n) + n - 0.5 * log(2 * pi) if n else 0.0
    m = n * n
    return (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / 1188 / m) / m) / m) / m) / n


def _deviance(x: float, mean: float) -> float:
    """x log(x / mean) + mean - x, without cancellation where they are close."""
    if abs(x - mean) >= 0.1 * (x + mean):
        return x * log(x / mean) + mean - x
    v = (x - mean) / (x + mean)
    s, ej, j = (x - mean) * v, 2 * x * v, 1
    while True:
        ej *= v * v
        if s + ej / (2 * j + 1) == s:
            return s
        s, j = s + ej / (2 * j + 1), j + 1


def _binomial(x: int, n: int, p: float, q: float) -> float:
    """Log of the binomial probability by Loader's saddle point: no difference of large numbers."""
    if x == 0:
        return n * log(q) if p >= 0.1 else n * log1p(-p)
    if x == n:
        return n * log(p) if q >= 0.1 else n * log1p(-q)
    c = _stirling(n) - _stirling(x) - _stirling(n - x) - _deviance(x, n * p) - _deviance(n - x, n * q)
    return c - 0.5 * (log(2 * pi) + log(x) + log1p(-x / n))


def _mass(x: int, good: int, bad: int, n: int) -> float:
    """Hypergeometric probability of x, to double precision for numbers of any size."""
    p, q = n / (good + bad), (good + bad - n) / (good + bad)
    return exp(_binomial(x, good, p, q) + _binomial(n - x, bad, p, q) - _binomial(n, good + bad, p, q))


def _hyper(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """A draw for urns beyond numpy's limit: the distribution inverted outward from its mode, in runs of both
    sides. It ends only inside the support: a u beyond the sum of all masses, by their rounding, is drawn again."""
    if n > (good + bad) // 2:
        return good - _hyper(rng, good, bad, good + bad - n)
    lo, hi = max(0, n - bad), min(n, good)
    mode = min(max((n + 1) * (good + 1) // (good + bad + 2), lo), hi)
    p0 = _mass(mode, good, bad, n)
    run = 64 + int(sqrt(n * (good / (good + bad)) * (bad / (good + bad))))
    while True:
        u = rng.random() - p0
        if u < 0:
            return mode
        up, down, pu, pd_ = mode, mode, p0, p0
        while (up < hi and pu > 0) or (down > lo and pd_ > 0):
            if up < hi and pu > 0:
                k = up + np.arange(min(run, hi - up), dtype=np.float64)
                mass = pu * np.cumprod((good - k) * (n - k) / ((k + 1) * (bad - n + k + 1)))
                total = np.cumsum(mass)
                if u < total[-1]:
                    return up + 1 + int(np.searchsorted(total, u, "right"))
                u, up, pu = u - total[-1], up + len(k), mass[-1]
            if down > lo and pd_ > 0:
                k = down - np.arange(min(run, down - lo), dtype=np.float64)
                mass = pd_ * np.cumprod(k * (bad - n + k) / ((good - k + 1) * (n - k + 1)))
                total = np.cumsum(mass)
                if u < total[-1]:
                    return down - 1 - int(np.searchsorted(total, u, "right"))
                u, down, pd_ = u - total[-1], down - len(k), mass[-1]


def keys(seed: int, row: Column) -> tuple[Column, Column]:
    """Keys of the permutation before and after the exchange: a stream each, whatever partition a row is in."""
    return F.xxhash64(F.lit(seed), F.lit(1), row), F.xxhash64(F.lit(seed), F.lit(2), row)


def shard(docs: DataFrame, shards: int | None = None, seed: int = SEED, shard_rows: int = SHARD_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """All rows and columns of docs, with shard (0 to shards - 1) and position (from 0) in it.

    Without a number of shards, as many as hold shard_rows rows at most each. group_rows bounds what
    one task permutes where shards are larger.

    A uniform random shuffle: shard sizes differ by one at most and are exact, and orders
    of rows are as likely as the keys' hash makes them, repeated rows too. Defined results: nulls, empty and long
    texts are rows like others, no column is looked at; shard and position get underscores added if
    docs has such columns; fewer rows than shards leave shards empty; an empty table gives an
    empty result.
    """
    docs = steady(docs)
    # Rows are counted over the same scan, so partition numbers agree.
    found = docs.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()  # one row a partition
    counts = np.zeros(max([r.p for r in found], default=-1) + 1, np.int64)
    for r in found:
        counts[r.p] = r["count"]
    rows = int(counts.sum())
    shards = shards or max(1, -(-rows // shard_rows))
    sizes = group_sizes(rows, shards, group_rows)
    sent = docs.sparkSession.sparkContext.broadcast((counts, sizes))  # partitions + groups numbers, not their product

    @F.pandas_udf("long")
    def to_group(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        """The first place of the row's group in the order of all rows."""
        counts, sizes = sent.value
        starts = np.cumsum(sizes) - sizes
        ends: dict[int, np.ndarray] = {}
        for p, rank in parts:
            out = np.zeros(len(p), np.int64)
            for q in p.unique():
                if q not in ends:
                    ends[q] = np.cumsum(matrix_row(counts, sizes, int(q), seed))
                here = (p == q).to_numpy()
                r = rank.to_numpy()[here]
                if len(r) and r.max() >= counts[q]:
                    raise ValueError("the input's partitions changed between two scans")
                out[here] = starts[np.searchsorted(ends[q], r, "right")]
            yield pd.Series(out)

    s, at = free_name(docs, "shard"), free_name(docs, "position")
    r1, r2, i, g = (free_name(docs, f"_{x}") for x in ("first", "second", "row", "group"))
    first, second = keys(seed, F.col(i))
    local = docs.withColumn(i, F.monotonically_increasing_id()).withColumns({r1: first, r2: second}).drop(i).sortWithinPartitions(r1)
    local = local.withColumn(i, F.monotonically_increasing_id())  # the partition, and the row's place in its permutation
    local = local.withColumn(g, to_group(F.shiftright(i, 33).cast("int"), F.col(i).bitwiseAND((1 << 33) - 1)))
    place = F.col(g) + F.row_number().over(Window.partitionBy(g).orderBy(r2)) - 1
    base, more = divmod(rows, shards)  # the first so many shards have a row more
    larger = F.col(at) < more * (base + 1)
    which = F.when(larger, F.floor(F.col(at) / F.lit(base + 1))).otherwise(more + F.floor((F.col(at) - more * (base + 1)) / F.lit(max(base, 1))))
    start = F.col(s) * base + F.least(F.col(s), F.lit(more))
    out = local.withColumn(at, place.cast("long")).withColumn(s, which.cast("int"))
    return out.select(*docs.columns, s, (F.col(at) - start).alias(at))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
