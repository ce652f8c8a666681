"""Mixing, sharding and packing against brute force."""

import hashlib
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmill.llm import mixing as M
from quillmill.llm import packing as P
from quillmill.llm import sharding as S
from quillmill.llm.tokens import encoder
from tests.llm.helpers import DOCS, empty, odd, write

TOKEN = re.compile(r"[^ \t\n\r\f]+")


def brute_mix(rows, weights, budget):
    """Indexes of rows (doc_id, text, source) served, with finish times."""
    keyed = [(hashlib.md5(f"{M.SEED}:{'' if d is None else d}:{t or ''}".encode()).hexdigest(), s, len(TOKEN.findall(t or "")), i) for i, (d, t, s) in enumerate(rows)]
    finish = {}
    for s in {k[1] for k in keyed}:
        own, so_far = sorted(k for k in keyed if k[1] == s), 0
        for key in sorted({k[0] for k in own}):
            peers = [k for k in own if k[0] == key]
            so_far += sum(k[2] for k in peers)
            finish |= {k[3]: so_far / weights.get(s, 1.0) for k in peers}
    order = defaultdict(list)
    for k in keyed:
        order[(finish[k[3]], k[0])].append(k)
    limit, so_far, out = int(sum(k[2] for k in keyed) * budget), 0, {}
    for place in sorted(order):
        so_far += sum(k[2] for k in order[place])
        if so_far > limit:
            break
        out |= {k[3]: place[0] for k in order[place]}
    return out


@pytest.mark.parametrize("budget", [0.0, 0.3, 0.5, 1.0])
def test_mix_is_the_queue_served_one_by_one(spark, sf, budget):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    weights = {"src0": 3.0, "src4": 0.25}
    want = sorted((rows[i][0], t) for i, t in brute_mix(rows, weights, budget).items())
    got = M.mix_sources(docs, weights, budget).select("doc_id", "virtual_finish").collect()
    assert [r.virtual_finish for r in got] == sorted(r.virtual_finish for r in got)
    assert sorted(map(tuple, got)) == want


@pytest.mark.parametrize("few", [1, 7])
def test_cut_narrows_to_few_rows(spark, few):
    """A source of tiny weight stretches the range of time; many rows without tokens share a time."""
    rows = [(i, f"s{i % 4}", " ".join(["w"] * (i % 9))) for i in range(1500)] + [(9000 + i, "zero", "") for i in range(300)] + [(5, "s1", "a b")] * 20
    docs = spark.createDataFrame([(i, t, "en", s, 0) for i, s, t in rows], DOCS)
    weights = {"s3": 1e-4, "s0": 1.0, "s1": 1.0}
    for budget in (0.0, 0.2, 0.5, 0.77, 1.0):
        want = Counter((rows[i][0], t) for i, t in brute_mix([(i, t, s) for i, s, t in rows], weights, budget).items())
        got = M.mix_sources(docs, weights, budget, few=few).select("doc_id", "virtual_finish", "tokens").collect()
        assert Counter((r.doc_id, r.virtual_finish) for r in got) == want
    served = M.mix_sources(docs, weights, 0.5, few=few, tokens=F.when(F.col("source") == "s2", 3).otherwise(1).cast("long"))
    assert {r.tokens for r in served.where("source = 's2'").collect()} == {3}


def test_mix_shares_follow_weights(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("a b c d e").alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("source"), F.lit(9).alias("n_chars"))
    got = M.mix_sources(docs, {"s0": 4.0, "s1": 2.0, "s2": 1.0}, 0.4).groupBy("source").agg(F.sum("tokens").alias("n")).collect()
    n = {r.source: r.n for r in got}
    assert n["s0"] / n["s2"] == pytest.approx(4, rel=0.02) and n["s1"] / n["s2"] == pytest.approx(2, rel=0.02)


def test_mix_cases(spark):
    clash = ("tokens", "virtual_finish", "m", "key", "finish", "part", "bucket", "upto")
    docs = odd(spark, clash)
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    for budget in (0.0005, 0.9, 1.0):
        got = M.mix_sources(docs, {"a": 2.0}, budget)
        assert got.columns == [*docs.columns, "tokens_", "virtual_finish_"]
        want = Counter((rows[i][0], t) for i, t in brute_mix(rows, {"a": 2.0}, budget).items())
        assert Counter((r.doc_id, r.virtual_finish_) for r in got.collect()) == want
    assert M.mix_sources(empty(spark)).count() == 0
    with pytest.raises(ValueError, match="positive"):
        M.mix_sources(docs, {"a": 0.0})


def plain_rows(counts, sizes, seed):
    return np.array([S.matrix_row(counts, sizes, p, seed) for p in range(len(counts))])


@given(st.lists(st.integers(0, 30), min_size=1, max_size=9), st.integers(1, 9), st.integers(0, 5))
@settings(max_examples=80, deadline=None)
def test_matrix_has_exact_margins(counts, shards, seed):
    counts = np.array(counts)
    sizes = S.shard_sizes(int(counts.sum()), shards)
    m = plain_rows(counts, sizes, seed)
    assert (m >= 0).all() and (m.sum(1) == counts).all() and (m.sum(0) == sizes).all()


def test_matrix_is_distributed_as_a_shuffle():
    counts, sizes = np.array([3, 2, 4]), np.array([5, 4])
    got = Counter(tuple(plain_rows(counts, sizes, s)[:, 0]) for s in range(4000))
    rng, owner = np.random.default_rng(1), np.repeat(np.arange(3), counts)
    want = Counter(tuple(np.bincount(rng.permutation(owner)[:5], minlength=3)) for _ in range(4000))
    chi = sum((got[k] - want[k]) ** 2 / (got[k] + want[k]) for k in got | want)
    assert chi < 2.5 * len(got | want)


def test_draws_beyond_the_library_limit():
    rng = np.random.default_rng(3)
    g = [S._hyper(rng, 3 * 10**9, 10**9, 2 * 10**9) for _ in range(400)]
    sd = np.sqrt(2e9 * 0.75 * 0.25 * 0.5)
    assert np.mean(g) == pytest.approx(1.5e9, abs=4 * sd / 20) and np.std(g) == pytest.approx(sd, rel=0.15)
    assert S._mass(3, 7, 5, 6) == pytest.approx(350 / 924, rel=1e-12)
    small = np.bincount([S._hyper(rng, 7, 5, 6) for _ in range(8000)], minlength=7)
    want = np.array([S._mass(x, 7, 5, 6) if x else 0 for x in range(7)]) * 8000
    assert ((small - want)[1:] ** 2 / want[1:]).sum() < 25 and small[0] == 0  # six degrees
    assert sum(S._mass(x, 5 * 10**10, 5 * 10**10, 40) for x in range(41)) == pytest.approx(1, rel=1e-9)


def test_a_row_of_a_vast_matrix_takes_seconds():
    """1e6 partitions, 3e10 rows, 3e7 shards: as many columns as groups, however many shards there are."""
    counts, sizes = S.shard_sizes(3 * 10**10, 10**6), S.group_sizes(3 * 10**10, 3 * 10**7)
    assert len(sizes) < 5 * 10**5 and sizes.sum() == 3 * 10**10
    began = time.process_time()
    row = S.matrix_row(counts, sizes, 123_456)
    assert row.sum() == counts[123_456] and (row >= 0).all() and time.process_time() - began < 15


@given(st.integers(0, 400), st.integers(1, 60), st.integers(1, 50))
@settings(max_examples=150, deadline=None)
def test_groups_nest_with_shards(rows, shards, group_rows):
    sizes, ends = S.group_sizes(rows, shards, group_rows), set(np.cumsum(S.shard_sizes(rows, shards)).tolist())
    assert sizes.sum() == rows and sizes.max(initial=0) <= max(group_rows, -(-rows // shards)) + group_rows
    groups = set(np.cumsum(sizes).tolist())
    assert groups <= ends or ends <= groups


def scanned(docs, path):
    docs.write.parquet(str(path))
    return docs.sparkSession.read.parquet(str(path))


@pytest.mark.parametrize(("shards", "group_rows"), [(7, S.GROUP_ROWS), (50, 20), (3, 15)])
def test_shards_are_exact_and_whole(spark, sf, tmp_path, shards, group_rows):
    docs = scanned(spark.read.parquet(f"{sf}/documents.parquet").repartition(5), tmp_path / "d")
    got = S.shard(docs, shards, group_rows=group_rows).collect()
    assert Counter(r.shard for r in got) == dict(enumerate(S.shard_sizes(docs.count(), shards).tolist()))
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in docs.collect())
    for s in range(shards):
        assert sorted(r.position for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    again = {(r.doc_id, r.shard, r.position) for r in S.shard(docs, shards, group_rows=group_rows).collect()}
    assert again == {(r.doc_id, r.shard, r.position) for r in got}
    # Brute force: the same draws and keys with plain loops.
    one, two = S.keys(S.SEED, F.monotonically_increasing_id())
    parts = docs.select("doc_id", F.spark_partition_id().alias("p"), one.alias("one"), two.alias("two")).collect()
    counts, sizes = np.bincount([r.p for r in parts]), S.group_sizes(len(parts), shards, group_rows)
    group = {}
    for p in range(len(counts)):
        mine = sorted((r for r in parts if r.p == p), key=lambda r: r.one)
        for r, g in zip(mine, np.repeat(np.arange(len(sizes)), S.matrix_row(counts, sizes, p)), strict=True):
            group[r.doc_id] = g
    order = sorted(parts, key=lambda r: (group[r.doc_id], r.two))
    where = [(s, i) for s, n in enumerate(S.shard_sizes(len(parts), shards)) for i in range(n)]
    assert {r.doc_id: w for r, w in zip(order, where, strict=True)} == {r.doc_id: (r.shard, r.position) for r in got}


def test_shuffle_is_uniform(spark, tmp_path):
    docs = scanned(spark.range(40, numPartitions=3).withColumnRenamed("id", "doc_id"), tmp_path / "u")
    first = Counter()
    for seed in range(30):
        first.update(r.doc_id for r in S.shard(docs, 4, seed, group_rows=10).where("position = 0").collect())
    assert max(first.values()) <= 12 and len(first) >= 34  # 120 draws over 40 rows


def chi_square(table):
    want = table.sum(1, keepdims=True) * table.sum(0, keepdims=True) / table.sum()
    return ((table - want) ** 2 / want).sum()


def test_shuffle_is_uniform_jointly(spark, tmp_path):
    """Where a row goes says nothing of where the row of the same place in the next partition goes.

    Streams seeded by seed + partition and seed + 1 + partition are one stream, a partition apart.
    """
    n, shards = 6000, 6
    docs = scanned(spark.range(4 * n, numPartitions=4).withColumnRenamed("id", "doc_id"), tmp_path / "j")
    parts = docs.withColumn("p", F.spark_partition_id()).collect()
    assert len({r.p for r in parts}) == 4
    got = {r.doc_id: (r.shard, r.position) for r in S.shard(docs, shards, group_rows=4 * n // shards).collect()}
    places = {p: [got[r.doc_id] for r in parts if r.p == p] for p in range(4)}
    for p in range(4):
        for q in range(4):
            if p == q:
                continue
            both = list(zip(places[p], places[q], strict=False))
            by_shard, by_place = np.zeros((shards, shards)), np.zeros((shards, 8))
            for (s, at), (t, _) in both:
                by_shard[s, t] += 1
                by_place[t, at * 8 // (4 * n // shards)] += 1
            assert chi_square(by_shard) < 65 and chi_square(by_place) < 80  # 25 and 35 degrees
    where = np.zeros((4, shards))
    for p in range(4):
        for s, _ in places[p]:
            where[p, s] += 1
    assert chi_square(where) < 45  # 15 degrees, a draw without replacement has less spread


def test_shard_cases(spark):
    clash = ("shard", "position", "_first", "_second", "_row", "_group")
    got = S.shard(odd(spark, clash), 4)  # not a scan: goes through a checkpoint
    assert got.columns == [*odd(spark, clash).columns, "shard_", "position_"]
    rows = got.collect()
    assert sorted(Counter(r.shard_ for r in rows).values()) == [2, 3, 3, 3] and len(rows) == 11
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in odd(spark).collect())
    assert S.shard(empty(spark), 4).count() == 0
    assert len(S.shard(odd(spark), 50).collect()) == 11


@given(st.lists(st.integers(0, 20), max_size=60))
@settings(max_examples=100, deadline=None)
def test_first_fit_is_first_fit(lengths):
    lengths = sorted(lengths, reverse=True)
    bins, want = [], []
    for n in lengths:
        i = next((i for i, b in enumerate(bins) if b + n <= 20), len(bins))
        if i == len(bins):
            bins.append(0)
        bins[i] += n
        want.append(i)
    assert P.first_fit(lengths, 20) == want


def brute_pack(rows, capacity):
    """Bins of rows (row, doc_id, tokens) of one group."""
    pieces = [(-min(capacity, n - at), row, at, d) for row, d, n in rows for at in range(0, max(n, 1), capacity)]
    bins = []
    for neg, _, at, d in sorted(pieces, key=lambda x: x[:3]):
        b = next((b for b in bins if sum(x[2] for x in b) - neg <= capacity), None)
        if b is None:
            bins.append(b := [])
        b.append((d, at, -neg))
    return bins


def test_whole_packing_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    enc, groups = encoder(), max(1, -(-docs.count() // 64))
    keyed = docs.withColumn("row", F.monotonically_increasing_id())
    rows = keyed.withColumn("g", F.expr(f"pmod(xxhash64({P.SEED}, row), {groups})")).collect()
    got, text = defaultdict(dict), {r.doc_id: enc.encode_ordinary(r.text or "") for r in rows}
    for r in P.pack(docs, 300, 64).collect():
        got[r.group_id][r.bin_id] = list(zip(r.doc_ids, r.starts, r.lengths, strict=True))
        assert r.tokens == sum(r.lengths) <= 300
        assert r.input_ids == [t for d, s, n in got[r.group_id][r.bin_id] for t in text[d][s : s + n]]
    assert len(got) == len({r.g for r in rows})
    for g in got:
        want = brute_pack([(r.row, r.doc_id, len(text[r.doc_id])) for r in rows if r.g == g], 300)
        assert [got[g][i] for i in range(len(got[g]))] == want


def unpacked(enc, bins):
    """Texts by document, from its parts in order; for tables where doc_id is unique."""
    parts = defaultdict(dict)
    for r in bins:
        at = 0
        for d, s, n in zip(r.doc_ids, r.starts, r.lengths, strict=True):
            assert s not in parts[d]
            parts[d][s] = r.input_ids[at : at + n]
            at += n
        assert at == len(r.input_ids) == r.tokens <= P.CAPACITY
    whole = {d: [t for s in sorted(p) for t in p[s]] for d, p in parts.items()}
    return {d: enc.decode(t, errors="strict") for d, t in whole.items()}


def test_query_decodes_to_every_text(spark, sf):
    want = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    bins = P.query(spark, sf).collect()
    assert unpacked(encoder(), bins) == want
    assert sum(r.tokens for r in bins) / (len(bins) * P.CAPACITY) > 0.95


def test_pack_cases(spark):
    docs = odd(spark, ("n", "piece", "row", "ids", "group_id", "start", "length", "tokens"))
    bins = P.pack(docs, 100).collect()
    seen = Counter(d for r in bins for d, s in zip(r.doc_ids, r.starts, strict=True) if s == 0)
    assert seen == Counter(r.doc_id for r in odd(spark).collect())
    assert sum(n for r in bins for d, n in zip(r.doc_ids, r.lengths, strict=True) if d == 6) >= 60_000
    assert P.pack(empty(spark)).count() == 0
    assert DOCS.startswith("doc_id") and write


def test_repeated_rows_spread_over_groups(spark):
    docs = spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same few words").alias("text"))
    bins = P.pack(docs, 100, group=100).collect()
    size = Counter()
    for r in bins:
        size[r.group_id] += len(r.doc_ids)
    assert len(size) == 20 and max(size.values()) < 160 and sum(size.values()) == 2000


def test_a_long_document_streams_through(spark):
    """Full pieces leave a group as they come; its rests are packed."""
    docs = spark.createDataFrame([(1, "word " * 400_000), (2, "short"), (3, None)], "doc_id long, text string")
    bins = P.pack(docs, 64, group=8).collect()
    assert [r.bin_id for r in sorted(bins, key=lambda r: r.bin_id)] == list(range(len(bins)))
    full = {s for r in bins for d, s in zip(r.doc_ids, r.starts, strict=True) if d == 1}
    assert full == set(range(0, max(full) + 64, 64)) and sum(r.tokens for r in bins) >= 400_000
