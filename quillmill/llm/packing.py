"""Packing documents into token sequences: first-fit decreasing over a tournament tree, in random groups.

Documents are encoded whole by a public byte-level BPE and dealt to random groups of about GROUP. A
document longer than a sequence is cut into full pieces and a rest; every piece is packed. Each
group is packed on its own: longest first, each into the first bin with room. A tournament tree of
the bins' free room finds that bin in log2(bins) steps.

Tokens move once, sorted by group and length. Full pieces come first in a group and are sequences of
their own, sent on as they arrive, so a task holds the rests of one group alone: less than
GROUP * capacity tokens for a group of GROUP, whatever the length of its documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.common import bound_batches, steady, table
from quillmill.llm.tokens import TOKENIZER, encode, encoder

CAPACITY, GROUP, SEED = 2048, 8192, 23
SCHEMA = "group_id long, bin_id int, doc_ids array<long>, starts array<long>, lengths array<int>, tokens int, input_ids array<int>"
#: Tokens sent on at a time.
_PART = 1 << 20


def first_fit(lengths: list[int], capacity: int) -> list[int]:
    """The bin of each length in the order given: the first with room, else a new one."""
    size = 1 << max(len(lengths) - 1, 0).bit_length()
    room = [capacity] * (2 * size)  # room[i]: the most in the subtree at i; leaves are the bins
    out = []
    for n in lengths:
        i = 1
        while i < size:
            i *= 2
            if room[i] < n:
                i += 1
        out.append(i - size)
        room[i] -= n
        i >>= 1
        while i:
            most = room[2 * i] if room[2 * i] > room[2 * i + 1] else room[2 * i + 1]
            if room[i] == most:
                break
            room[i] = most
            i >>= 1
    return out


def _pieces(path: str, capacity: int):
    """group_id, row, doc_id, start, length, ids: pieces of capacity tokens and the rest, which may be empty for an empty document only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        held, at, start, size = [], [], [], 0

        def send(b: pa.RecordBatch) -> pa.RecordBatch:
            length = np.array([len(x) for x in held], np.int32)
            ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(length)].astype(np.int32)), pa.array(np.concatenate(held)))
            pick = pa.array(at)
            return pa.RecordBatch.from_arrays([*(b.column(c).take(pick) for c in ("group_id", "row", "doc_id")), pa.array(start, pa.int64()), pa.array(length), ids], ["group_id", "row", "doc_id", "start", "length", "ids"])

        for b in batches:
            for i, text in enumerate(b.column("text")):
                ids = encode(enc, text.as_py())
                for s in range(0, max(len(ids), 1), capacity):
                    held.append(ids[s : s + capacity])
                    at.append(i)
                    start.append(s)
                    size += len(held[-1])
                    if size > _PART:
                        yield send(b)
                        held, at, start, size = [], [], [], 0
            if held:
                yield send(b)
                held, at, start, size = [], [], [], 0

    return run


def _take(a: np.ndarray, off: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The spans off[i]..off[i + 1] of a, in this order."""
    count = np.diff(off)[order]
    new = np.r_[0, np.cumsum(count)]
    return a[np.repeat(off[order] - new[:-1], count) + np.arange(new[-1])]


def _sequences(capacity: int):
    """Bins of groups, from pieces sorted by group, longest first."""

    def bins(group: int, first: int, bin_of: np.ndarray, doc: pa.Array, start: np.ndarray, length: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(bin_of, kind="stable")
        off = np.r_[0, np.cumsum(length)].astype(np.int64)
        ends = np.r_[0, np.cumsum(np.bincount(bin_of))]
        step = max(1, _PART // capacity)
        for a in range(0, len(ends) - 1, step):
            e = ends[a : a + step + 1]
            pick = order[e[0] : e[-1]]
            lists = lambda v: pa.ListArray.from_arrays(pa.array((e - e[0]).astype(np.int32)), v)  # noqa: B023, E731
            used = np.add.reduceat(length[pick], e[:-1] - e[0])
            tokens = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(used)].astype(np.int32)), pa.array(_take(ids, off, pick)))
            n = len(e) - 1
            cols = [pa.array(np.full(n, group)), pa.array((first + a + np.arange(n)).astype(np.int32)), lists(doc.take(pa.array(pick))), lists(pa.array(start[pick])), lists(pa.array(length[pick])), pa.array(used.astype(np.int32)), tokens]
            yield pa.RecordBatch.from_arrays(cols, ["group_id", "bin_id", "doc_ids", "starts", "lengths", "tokens", "input_ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, full, rest = None, 0, []

        def close() -> Iterator[pa.RecordBatch]:
            if rest:
                doc = pa.concat_arrays([r[0] for r in rest])
                start, length, ids = (np.concatenate([r[i] for r in rest]) for i in (1, 2, 3))
                yield from bins(group, full, np.array(first_fit(length.tolist(), capacity)), doc, start, length, ids)

        for b in batches:
            if not b.num_rows:
                continue
            key, doc, start, length, tokens = b.column("group_id").to_numpy(), b.column("doc_id"), b.column("start").to_numpy(), b.column("length").to_numpy(), b.column("ids")
            off, ids = np.asarray(tokens.offsets).astype(np.int64), tokens.values.to_numpy()
            edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
            for x, y in zip(edges[:-1], edges[1:], strict=True):
                if key[x] != group:
                    yield from close()
                    group, full, rest = int(key[x]), 0, []
                cut = x + int((length[x:y] == capacity).sum())
                if cut > x:
                    yield from bins(group, full, np.arange(cut - x), doc.slice(x, cut - x), start[x:cut], length[x:cut], ids[off[x] : off[cut]])
                    full += cut - x
                if y > cut:
                    rest.append((doc.slice(cut, y - cut), start[cut:y].copy(), length[cut:y].copy(), ids[off[cut] : off[y]].copy()))
        yield from close()

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, group: int = GROUP, seed: int = SEED, tokenizer: str = TOKENIZER) -> DataFrame:
    """group_id, bin_id, doc_ids, starts, lengths, tokens, input_ids: one row a sequence of docs (doc_id, text, ...).

    Part i of input_ids is the next lengths[i] of them: those of document doc_ids[i] from its token
    starts[i] on. Defined results: a null or empty text is one piece of length 0, in a bin of its
    group; a null doc_id is carried as null; every row is dealt to a group by itself, so repeated rows are packed each and spread
    over groups; ties in length go by the row's place in the table, then start; an empty table gives an empty result; other columns play no part.
    """
    docs = steady(docs)
    groups = max(1, ceil(docs.count() / group))  # Parquet footers answer it
    row = F.monotonically_increasing_id()
    rows = bound_batches(docs).select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.select(F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(groups)).alias("group_id"), "row", "doc_id", "text")
    pieces = rows.mapInArrow(_pieces(tokenizer, capacity), "group_id long, row long, doc_id long, start long, length int, ids array<int>")
    dealt = pieces.repartition("group_id").sortWithinPartitions("group_id", F.desc("length"), "row", "start")
    return dealt.mapInArrow(_sequences(capacity), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
