"""Near duplicates against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmill.llm import near_dedup as N
from quillmill.llm.bytekernel import slices
from tests.llm.helpers import DOCS, empty, odd


def plain_superminhash(elems, m):
    """The published algorithm with its loops, on the same random numbers."""
    from quillmill.llm.bytekernel import _U, mix

    h, p, q, b, a = [np.inf] * m, [0] * m, [-1] * m, [0] * m, m - 1
    b[m - 1] = m
    for i, e in enumerate(elems):
        j = 0
        while j <= a:
            x = mix(np.array([e], np.uint64) + _U((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            r = float((x >> _U(11)).astype(np.float64)[0]) * 2.0**-53
            k = j + int((mix(x ^ _U(0xA0761D6478BD642F)) % _U(m - j))[0])
            if q[j] != i:
                q[j], p[j] = i, j
            if q[k] != i:
                q[k], p[k] = i, k
            p[j], p[k] = p[k], p[j]
            if r + j < h[p[j]]:
                old = min(int(h[p[j]]), m - 1) if np.isfinite(h[p[j]]) else m - 1
                h[p[j]] = r + j
                if j < old:
                    b[old] -= 1
                    b[j] += 1
                    while b[a] == 0:
                        a -= 1
            j += 1
    return h


@pytest.mark.parametrize("n", [1, 2, 7, 40, 300])
def test_signature_equals_the_sequential_algorithm(n):
    rng = np.random.default_rng(n)
    elem = rng.integers(0, 1 << 63, n).astype(np.uint64)
    got = N.superminhash(elem, np.zeros(n, np.int64), 1, 32)[0]
    assert got.tolist() == plain_superminhash(elem, 32)


def test_signature_estimates_jaccard():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    a, b = pool[:200], pool[100:]
    sig = N.superminhash(np.concatenate([a, b]), np.repeat([0, 1], 200), 2, 512)
    assert abs((sig[0] == sig[1]).mean() - 1 / 3) < 0.07


def sets(texts):
    out = []
    for s in slices(pa.array(texts, pa.string())):
        h, doc = N.shingles(s)
        out += [set(h[doc == i].tolist()) for i in range(s.n)]
    return out


def brute(rows, threshold):
    """Group of each (doc_id, text): components of pairs at the threshold, and of identical texts."""
    sh, parent = sets([t for _, t in rows]), list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][1] is None or rows[j][1] is None:
                continue
            n = len(sh[i] & sh[j])
            if rows[i][1] == rows[j][1] or n and n >= threshold * (len(sh[i]) + len(sh[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(rows))]


def test_whole_query_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    want = brute(rows, N.THRESHOLD)
    got = {r.doc_id: r for r in N.query(spark, sf).collect()}
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if want[i] == want[j]]
    hit = sum(got[rows[i][0]].group_id == got[rows[j][0]].group_id for i, j in pairs)
    assert pairs and hit >= 0.9 * len(pairs)
    for i, (doc, _) in enumerate(rows):  # nothing is grouped that brute force keeps apart
        assert want[[d for d, _ in rows].index(got[doc].group_id)] == want[i]
    assert all(r.keep == (r.doc_id == r.group_id) for r in got.values())


def test_large_family_and_shared_passage(spark):
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    base = [word() for _ in range(120)]
    rows = []
    for i in range(150):  # copies with edits of a base, further from each other than from it
        w = list(base)
        for k in rng.choice(120, 6, replace=False):
            w[k] = word()
        rows.append((i, " ".join(w)))
    passage = [word() for _ in range(40)]
    rows += [(1000 + i, " ".join([word() for _ in range(150)] + passage)) for i in range(100)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    got = {r.doc_id: r.group_id for r in N.groups(docs).collect()}
    assert {got[i] for i in range(150)} == {0}
    assert all(got[1000 + i] == 1000 + i for i in range(100))


@pytest.mark.parametrize("blocks", [1, 2])
def test_pairs_in_place_are_all_pairs(blocks):
    rng = np.random.default_rng(8)
    common = rng.integers(0, 1 << 31, 60)
    members = []
    for i in range(90):
        own = rng.integers(0, 1 << 31, rng.integers(1, 80))
        base = members[rng.integers(0, len(members))] if i and i % 3 == 0 else own
        members.append(np.unique(np.concatenate([base[rng.random(len(base)) < 0.9], own[: 1 + i % 7], common[: 60 * (i % 2)]])).astype(np.int32))
    root, block = rng.integers(0, 60, 90), rng.integers(0, blocks, 90)
    size = np.array([len(m) for m in members])
    a, b = N.similar(root, block, size, np.concatenate(members), 0.5)
    want = set()
    for i in range(90):
        for j in range(i + 1, 90):
            both = len(np.intersect1d(members[i], members[j]))
            if root[i] != root[j] and (blocks == 1 or block[i] != block[j]) and both >= 0.5 * (size[i] + size[j] - both):
                want.add((i, j))
    assert {(min(x), max(x)) for x in zip(a.tolist(), b.tolist(), strict=True)} == want and len(want) > 5


def test_blocks_of_a_hot_bucket_agree(spark):
    rng = np.random.default_rng(9)
    rows, sets = [], []
    for i in range(120):
        base = rng.integers(0, 1 << 30, 40) if i % 2 == 0 else np.array(sets[-1][1])
        sets.append((i, np.unique(np.r_[base[:36], rng.integers(0, 1 << 30, 4)]).astype(int).tolist()))
        rows += [(5, i, i, 120), (7, i, i // 10, 120)]
    split, have = spark.createDataFrame(rows, "band long, id long, root long, m long"), spark.createDataFrame(sets, "id long, shingles array<int>")
    got = [sorted(map(tuple, N.crossing(split, have, 0.5, most).collect())) for most in (1000, 7, 1)]
    assert got[0] == got[1] == got[2] and len(got[0]) >= 60


def test_a_passage_shared_by_very_many_documents(spark):
    """20,000 documents around one passage, 60 pairs of copies among them: the pairs are found, nothing else is."""
    rng = np.random.default_rng(11)
    vocabulary = np.array(["".join(rng.choice(list("abcdefghijklm"), 5)) for _ in range(4000)])
    passage = " ".join(vocabulary[:45])
    rows = []
    for i in range(20_000):
        if i >= 19_940:  # a copy of document i - 19,940 with two other words
            w = rows[i - 19_940][1].split()
            w[3], w[-3] = "first", "last"
            rows.append((i, " ".join(w)))
        else:
            w = vocabulary[rng.integers(45, 4000, 70)]
            rows.append((i, " ".join(w[:20]) + " " + passage + " " + " ".join(w[20:])))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    found = sorted((r.group_id, r.doc_id) for r in N.groups(docs).where("group_size > 1").collect())
    pairs = [p for i in range(60) for p in ((i, i), (i, 19_940 + i))]
    assert set(found) <= set(pairs) and len(found) >= 0.95 * len(pairs)  # brute force knows no other pair: see below
    some = rows[:40] + rows[19_940:19_980]
    want = brute(some, N.THRESHOLD)
    assert [want[i] for i in range(40, 80)] == list(range(40))


def test_cases(spark):
    clash = ("id", "band", "root", "nth", "text_id", "keep", "count")
    got = N.groups(odd(spark, clash)).collect()
    assert len(got) == 11
    assert sum(r.keep for r in got if r.doc_id == 1) == 1 and [r.group_size for r in got if r.doc_id == 1] == [2, 2]
    assert [r.keep for r in got if r.doc_id == 2] == [True, True]  # null texts
    assert {r.doc_id: r.keep for r in got if r.doc_id in (3, 4, 5)} == {3: True, 4: False, 5: True}
    kept = N.drop_copies(odd(spark, clash))
    assert kept.columns == odd(spark, clash).columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert ids == sorted((r.doc_id is None, r.doc_id or 0) for r in got if r.keep)
    assert N.groups(empty(spark)).count() == 0 and N.drop_copies(empty(spark)).count() == 0


def test_drop_agrees_with_groups(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.union(docs.where("doc_id < 20"))  # repeated rows
    kept = sorted(r.doc_id for r in N.drop_copies(docs).select("doc_id").collect())
    assert kept == sorted(r.doc_id for r in N.groups(docs).where("keep").collect())


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (80, 2)) if a != b] + [(i, i + 1) for i in range(500, 540)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    got = {r.id: r.root for r in N.components(df).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}


def test_moved_texts_and_sent_ids_agree(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sent = sorted(map(tuple, N.groups(docs).select("doc_id", "group_id", F.col("keep").cast("int")).collect()))
    monkeypatch.setattr(N, "SEND_IDS", 0)
    moved = sorted(map(tuple, N.groups(docs).select("doc_id", "group_id", F.col("keep").cast("int")).collect()))
    assert sent == moved
