"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score(x) = b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j. The pairwise part is taken in time
linear in the number of features by the identity
    sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ].
Features: each distinct word of the whole text, hashed to 2^WORD_BITS, value 1/sqrt(distinct
words); each structure statistic, cut at training quantiles into LEVELS indicators, value
1/sqrt(statistics); language and source, hashed, value 1/2. Trained here on labels.quality, at
most TRAIN_ROWS of them, by Adagrad on the logistic loss.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.boosting import sigmoid
from quillmill.llm.bytekernel import _U, Slice, mix, slices, span_hash, words
from quillmill.llm.common import bound_batches, free_name, labelled, table
from quillmill.llm.docstats import NAMES, structure
from quillmill.llm.quality_rules import scored

TRAIN_ROWS, KEEP = 20_000, 0.5
WORD_BITS, META_BITS, LEVELS, RANK = 16, 10, 8, 8
EPOCHS, BATCH, RATE, L2 = 10, 256, 0.1, 1e-3
_STATS = 1 << WORD_BITS
_META = _STATS + LEVELS * len(NAMES)
DIM = _META + (1 << META_BITS)


def meta_slots(lang: pa.Array, source: pa.Array) -> np.ndarray:
    """(rows, 2) hashed slots; null is a value of its own."""
    out = []
    for salt, a in enumerate((lang, source)):
        a = pc.fill_null(a.cast(pa.large_string()), "\0")
        off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
        data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] else np.zeros(0, np.uint8)
        h = mix(span_hash(data, off[:-1], off[1:]) + _U(salt + 1)) if len(a) else np.zeros(0, np.uint64)
        out.append(_META + (h % _U(1 << META_BITS)).astype(np.int64))
    return np.column_stack(out)


def word_slots(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Structure statistics, offsets, and the distinct word slots of each row."""
    w = words(s)
    both = np.unique((w.doc.astype(np.int64) << WORD_BITS) | (w.hash & _U((1 << WORD_BITS) - 1)).astype(np.int64))
    off = np.searchsorted(both, np.arange(s.n + 1, dtype=np.int64) << WORD_BITS)
    return structure(s, w), off, both & ((1 << WORD_BITS) - 1)


@dataclass
class Machine:
    bias: float
    w: np.ndarray
    v: np.ndarray
    cuts: np.ndarray

    def rows(self, stats: np.ndarray, off: np.ndarray, slots: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Offsets, feature numbers and values of each row."""
        n, m = stats.shape
        level = sum((stats > self.cuts[None, :, i]).astype(np.int64) for i in range(LEVELS - 1))
        fixed = np.concatenate([_STATS + np.arange(m) * LEVELS + level, meta], axis=1)
        count = np.diff(off)
        new = off + np.arange(n + 1) * fixed.shape[1]
        feature, value = np.empty(new[-1], np.int64), np.empty(new[-1], np.float32)
        tail = new[1:, None] - fixed.shape[1] + np.arange(fixed.shape[1])
        head = np.arange(len(slots)) + np.repeat(np.arange(n) * fixed.shape[1], count)
        feature[head], value[head] = slots, np.repeat(1 / np.sqrt(np.maximum(count, 1)), count)
        feature[tail] = fixed
        value[tail] = np.r_[np.full(m, 1 / np.sqrt(m)), 0.5, 0.5]
        return new, feature, value

    def margin(self, off: np.ndarray, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
        if len(off) == 1:
            return np.zeros(0)
        vx = self.v[feature] * value[:, None]  # every row has features, so reduceat sees no empty span
        s, q = np.add.reduceat(vx, off[:-1], axis=0), np.add.reduceat(vx * vx, off[:-1], axis=0)
        return self.bias + np.add.reduceat(self.w[feature] * value, off[:-1]) + 0.5 * (s * s - q).sum(axis=1)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for s in slices(b.column("text")):
            stats, off, slots = word_slots(s)
            meta = meta_slots(b.column("lang").slice(s.first, s.n), b.column("source").slice(s.first, s.n))
            each = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(s.n + 1, dtype=np.int32) * a.shape[1]), pa.array(a.ravel()))  # noqa: B023, E731
            cols = [b.column("y").slice(s.first, s.n), each(stats), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(slots.astype(np.int32))), each(meta)]
            yield pa.RecordBatch.from_arrays(cols, ["y", "stats", "slots", "meta"])


def fit(y: np.ndarray, stats: np.ndarray, off: np.ndarray, slots: np.ndarray, meta: np.ndarray, epochs: int = EPOCHS, seed: int = 3) -> Machine:
    rng = np.random.default_rng(seed)
    cuts = np.quantile(stats, np.arange(1, LEVELS) / LEVELS, axis=0).T.astype(np.float32)
    m = Machine(float(np.log(y.mean() / (1 - y.mean()))), np.zeros(DIM, np.float32), rng.normal(0, 0.05, (DIM, RANK)).astype(np.float32), cuts)
    off, feature, value = m.rows(stats, off, slots, meta)
    gw, gv = np.full(DIM, 1e-6, np.float32), np.full((DIM, RANK), 1e-6, np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), BATCH):
            pick = order[i : i + BATCH]
            count = off[pick + 1] - off[pick]
            o = np.r_[0, np.cumsum(count)]
            at = np.repeat(off[pick] - o[:-1], count) + np.arange(o[-1])
            f, x = feature[at], value[at]
            vx = m.v[f] * x[:, None]
            s, q = np.add.reduceat(vx, o[:-1], axis=0), np.add.reduceat(vx * vx, o[:-1], axis=0)
            z = m.bias + np.add.reduceat(m.w[f] * x, o[:-1]) + 0.5 * (s * s - q).sum(axis=1)
            err = ((sigmoid(z) - y[pick]) / len(pick)).astype(np.float32)
            e = np.repeat(err, count)
            m.bias -= RATE * float(err.sum())
            u, inv = np.unique(f, return_inverse=True)
            dw = np.bincount(inv, e * x, len(u)).astype(np.float32) + L2 * m.w[u]
            full = (e * x)[:, None] * (np.repeat(s, count, axis=0) - vx)
            dv = np.column_stack([np.bincount(inv, full[:, k], len(u)) for k in range(RANK)]).astype(np.float32) + L2 * m.v[u]
            gw[u] += dw * dw
            gv[u] += dv * dv
            m.w[u] -= RATE * dw / np.sqrt(gw[u])
            m.v[u] -= RATE * dv / np.sqrt(gv[u])
    return m


def train(spark: SparkSession, sf_dir: str, rows: int = TRAIN_ROWS) -> Machine:
    """Without labels of both kinds, a machine that keeps everything."""
    sample = bound_batches(labelled(spark, sf_dir, "quality", rows)).select("text", "lang", "source", "y")
    got = sample.mapInArrow(_features, "y double, stats array<float>, slots array<int>, meta array<long>").toArrow()
    y = got.column("y").to_numpy()
    if len(y) == 0 or y.min() == y.max():
        return Machine(14.0, np.zeros(DIM, np.float32), np.zeros((DIM, RANK), np.float32), np.zeros((len(NAMES), LEVELS - 1), np.float32))
    flat = lambda c: got.column(c).combine_chunks()
    stats, meta, lists = flat("stats").values.to_numpy().reshape(len(y), -1), flat("meta").values.to_numpy().reshape(len(y), -1), flat("slots")
    off, slots = np.asarray(lists.offsets).astype(np.int64), lists.values.to_numpy().astype(np.int64)
    order = np.lexsort(np.vstack([stats.T, meta.T, y]))  # rows come in any order; the machine doesn't follow it
    count = np.diff(off)[order]
    new = np.r_[0, np.cumsum(count)]
    at = np.repeat(off[order] - new[:-1], count) + np.arange(new[-1])
    return fit(y[order], stats[order], new, slots[at], meta[order])


def scores(docs: DataFrame, machine: Machine, name: str = "quality_score") -> DataFrame:
    def score(text: pa.Array, lang: pa.Array, source: pa.Array) -> Iterator[np.ndarray]:
        for s in slices(text):
            stats, off, slots = word_slots(s)
            meta = meta_slots(lang.slice(s.first, s.n), source.slice(s.first, s.n))
            yield sigmoid(machine.margin(*machine.rows(stats, off, slots, meta)))

    return scored(docs, name, ["text", "lang", "source"], score)


def judge(docs: DataFrame, machine: Machine, keep: float = KEEP) -> DataFrame:
    """doc_id, quality_score, keep for each row of docs (doc_id, text, lang, source, ...).

    Defined results: a null text has a null score and isn't kept; an empty text is scored by
    its statistics and metadata alone; a null language or source is a value of its own;
    repeated rows get equal scores; an empty table gives an empty result; further columns of
    any name change nothing.
    """
    return scores(docs.select("doc_id", "text", "lang", "source"), machine).drop("text", "lang", "source").withColumn("keep", F.coalesce(F.col("quality_score") >= keep, F.lit(False)))


def keep_good(docs: DataFrame, machine: Machine, keep: float = KEEP) -> DataFrame:
    """The rows of docs that judge() keeps, with their columns."""
    name = free_name(docs, "quality_score")
    return scores(docs, machine, name=name).where(F.col(name) >= keep).drop(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), train(spark, sf_dir))
