"""Near-duplicate documents: SuperMinHash signatures, banding, exact verification, union-find.

A document is the set of hashes of its runs of SHINGLE words. Two documents are near
duplicates if the Jaccard similarity of their sets is at least THRESHOLD; groups are the
connected components. Identical texts are one vertex throughout, so a thousand copies cost as
much as one.

1. Signatures. SuperMinHash gives element e a random permutation of the M slots, drawn a step
   at a time: step j swaps position j with one from j to M-1, and the slot now at j gets the
   value r + j, r uniform in [0, 1). A slot keeps its least value. After step j every slot
   with a value below j + 1 is final, so a document stops once its largest value is: about
   ln(M) M / n steps, two or three in all for a few hundred words. All documents of a slice
   take a step together in numpy.
2. Bands of ROWS slots become bucket keys. Each member of a bucket is paired with its least.
3. Verification: the exact Jaccard similarity of the sets of whole texts.
4. Union-find within partitions of the edge table, then star contractions between them.
5. Where a bucket then still holds several components, all its pairs across them are verified in
   place, by their sets: exactly, with a prefix filter by the elements that are rare in the bucket. A set
   moves once for each such bucket (in a hot one, once for each pair of blocks that it is in).
   Hence the groups are the components of all candidate pairs that pass, and pairs
   known to be connected are never compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.llm.bytekernel import _U, Slice, grams, mix, slices, words
from quillmill.llm.common import bound_batches, free_name, own, stash, table

SHINGLE, BANDS, ROWS, THRESHOLD = 3, 40, 4, 0.5
#: Members of a bucket that are compared in one piece; larger buckets are compared by pairs of such blocks.
BLOCK = 1024
#: The most ids (8 bytes each) that are sent to every executor.
SEND_IDS = 2_000_000


def superminhash(elem: np.ndarray, doc: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """(n_docs, m) signatures; slots of documents without elements are inf."""
    sig = np.full(n_docs * m, np.inf)
    swaps: list[np.ndarray] = []
    for j in range(m):
        if not len(elem):
            break
        x = mix(elem + _U((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        r = (x >> _U(11)).astype(np.float64) * 2.0**-53
        k = (j + mix(x ^ _U(0xA0761D6478BD642F)) % _U(m - j)).astype(np.int16)
        slot = k.copy()  # what stood at k after the earlier swaps, traced back
        for t in range(j - 1, -1, -1):
            slot[slot == swaps[t]] = t
        np.minimum.at(sig, doc * m + slot, r + j)
        open_ = (sig.reshape(n_docs, m).max(axis=1) >= j + 1)[doc]
        if not open_.all():
            elem, doc, k = elem[open_], doc[open_], k[open_]
            swaps = [s[open_] for s in swaps]
        swaps.append(k)
    return sig.reshape(n_docs, m)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = sig.view(np.uint64).reshape(len(sig), bands, rows)
    h = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(sig), bands)).copy()
    for i in range(rows):
        h = mix(h * _U(0xD6E8FEB86659FD93) + bits[:, :, i])
    return h.view(np.int64)


def shingles(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    return grams(words(s), SHINGLE)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for s in slices(b.column("text")):
            elem, doc = shingles(s)
            some = np.flatnonzero(np.bincount(doc, minlength=s.n))
            keys = band_keys(superminhash(elem, doc, s.n, BANDS * ROWS)[some], BANDS, ROWS)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("id").slice(s.first, s.n).take(pa.array(some)), lists], ["id", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for s in slices(b.column("text")):
            elem, doc = shingles(s)
            both = np.unique((doc.astype(np.uint64) << _U(32)) | (elem >> _U(32)))
            off = np.searchsorted(both, np.arange(s.n + 1, dtype=np.uint64) << _U(32))
            lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(both.astype(np.uint32).view(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column("id").slice(s.first, s.n), lists], ["id", "shingles"])


def text_id(text: Column | str) -> Column:
    """Vertex of a text: 64 bits, null for a null text."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(text.isNotNull(), F.xxhash64(text))


def buckets(texts: DataFrame) -> DataFrame:
    """band, id, least for texts (id, text): the buckets of two or more, each with its least id."""
    keys = texts.mapInArrow(_bands, "id long, bands array<long>")
    rows = keys.select("id", F.explode("bands").alias("band"))
    w = Window.partitionBy("band")
    return rows.withColumns({"least": F.min("id").over(w), "most": F.max("id").over(w)}).where("least < most").select("band", "id", "least")


def _among(texts: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """texts semi- or anti-joined with a table of ids: texts stay where they are while the ids
    are few enough to send everywhere, else both sides move by id."""
    return texts.join(F.broadcast(ids) if ids.count() <= SEND_IDS else ids, ids.columns[0], how)


def verified(texts: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """Those of pairs (a, b) whose texts reach the threshold; only texts in some pair are read out."""
    wanted = stash(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    # One text of each id: identical ids are identical texts.
    sets = stash(_among(texts, wanted, "left_semi").mapInArrow(_sets, "id long, shingles array<int>").dropDuplicates(["id"]))
    left, right = (sets.select(F.col("id").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(left, "a").join(right, "b").where(both >= threshold * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def similar(root: np.ndarray, block: np.ndarray, size: np.ndarray, elem: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs at the threshold among sets of these sizes, concatenated in elem, but for pairs of one root
    or, if there are two blocks, of one block. Exact.

    Two sets at the threshold share one of the n - ceil(threshold n) + 1 elements that are rarest here of
    either (prefix filtering), so sets that have no more than a common passage in common aren't compared.
    """
    n = len(size)
    _, code, often = np.unique(elem, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), size)
    order = np.lexsort((code, often[code], owner))
    off = np.r_[0, np.cumsum(size)]
    early = (np.arange(len(elem)) - off[owner]) < (size - np.ceil(threshold * size - 1e-9) + 1)[owner]
    rare, who = code[order][early], owner[early]
    order = np.argsort(rare, kind="stable")
    rare, who = rare[order], who[order]
    meet = np.zeros((n, n), bool)
    at = np.arange(len(rare))
    step = 1
    while True:  # pairs of equal elements, step places apart; owners ascend within an element
        at = at[at + step < len(rare)]
        at = at[rare[at] == rare[at + step]]
        if not len(at):
            break
        meet[who[at], who[at + step]] = True
        step += 1
    two = block.min() != block.max()
    left, right, mark = [], [], np.zeros(len(often), bool)
    for i in np.flatnonzero(meet.any(axis=1)):
        j = np.flatnonzero(meet[i])
        j = j[(root[j] != root[i]) & (np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j])) & ((block[j] != block[i]) if two else True)]
        if not len(j):
            continue
        own = code[off[i] : off[i + 1]]
        mark[own] = True
        count = size[j]
        new = np.r_[0, np.cumsum(count)]
        both = np.add.reduceat(mark[code[np.repeat(off[j] - new[:-1], count) + np.arange(new[-1])]].astype(np.int64), new[:-1])
        mark[own] = False
        j = j[both >= threshold * (size[i] + count - both)]
        left.append(np.full(len(j), i))
        right.append(j)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _across(threshold: float):
    """Pairs of a bucket in different components at the threshold.

    Takes rows (band, lo, hi, block, id, root, shingles) sorted by band, lo, hi; holds one pair of blocks at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                block, ids, root, size, elem = (np.concatenate([h[i] for h in held]) for i in range(5))
                a, b = similar(root, block, size, elem, threshold)
                if len(a):
                    a, b = ids[a], ids[b]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.column_stack([batch.column(i).to_numpy() for i in range(3)])
            block, ids, root = (batch.column(i).to_numpy() for i in (3, 4, 5))
            off, elem = np.asarray(batch.column(6).offsets).astype(np.int64), batch.column(6).values.to_numpy()
            edges = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1), True])
            for x, y in zip(edges[:-1], edges[1:], strict=True):
                if tuple(keys[x]) != key:
                    yield from close()
                    key, held = tuple(keys[x]), []
                held.append((block[x:y].copy(), ids[x:y].copy(), root[x:y].copy(), np.diff(off[x : y + 1]), elem[off[x] : off[y]].copy()))
        yield from close()

    return run


def crossing(split: DataFrame, sets: DataFrame, threshold: float, most: int = BLOCK) -> DataFrame:
    """a, b: the pairs at the threshold of different roots within the bands of split (band, id, root, m: members of the band).

    A band of over most members is dealt to blocks by a hash of the id, and each pair of blocks is a task of
    its own, so what a task holds doesn't grow with the band.
    """
    blocks = F.ceil(F.col("m") / most).cast("int")
    dealt = split.withColumn("n", blocks).withColumn("block", F.pmod(F.xxhash64(F.lit(3), "id"), F.col("n")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other")
    dealt = dealt.select("band", "block", "id", "root", other).select("band", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "id", "root")
    rows = dealt.join(sets, "id").select("band", "lo", "hi", "block", "id", "root", "shingles")
    rows = rows.repartition("band", "lo", "hi").sortWithinPartitions("band", "lo", "hi")
    return rows.mapInArrow(_across(threshold), "a long, b long").distinct()


def _find(parent: dict[int, int], x: int) -> int:
    while (p := parent.setdefault(x, x)) != x:
        parent[x] = x = parent.setdefault(p, p)
    return x


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over a partition's edges: each vertex with its least, a spanning forest of stars."""
    parent: dict[int, int] = {}
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = _find(parent, a), _find(parent, b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if _find(parent, x) != x]
    for i in range(0, len(nodes), 50_000):
        part = nodes[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([_find(parent, x) for x in part], pa.int64())], ["id", "root"])


def components(edges: DataFrame) -> DataFrame:
    """id, root for every vertex of edges (a, b) that isn't the least of its component.

    Local union-find shrinks each partition to stars; a large-star and a small-star step per
    round link stars that share vertices (Kiveris et al.). The rounds, each written out, end
    when nothing changes: O(log^2 n) at most, two or three for near duplicates.
    """
    stars = edges.select("a", "b").mapInArrow(_forest, "id long, root long")
    stars = stash(stars.select("id", "root").distinct())
    before = None
    while True:
        now = stars.agg(F.count("*"), F.sum(F.col("root").cast("decimal(38,0)")), F.sum(F.xxhash64("id", "root").cast("decimal(38,0)"))).first()
        if now == before:
            return stars
        before = now
        both = stars.select(F.col("id").alias("u"), F.col("root").alias("v")).union(stars.select("root", "id"))
        least = F.min("v").over(Window.partitionBy("u"))
        large = both.select("u", "v", F.least("u", least).alias("m")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = F.min("v").over(Window.partitionBy("u"))
        small = large.select("u", "v", least.alias("m"))
        small = small.select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e")).select("e.u", "e.m").where("u > m")
        stars = stash(small.select(F.col("u").alias("id"), F.col("m").alias("root")).distinct())


def roots(texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """id, root of all texts (id, text) that are in a group, but for the root itself."""
    shared = stash(buckets(bound_batches(texts)))
    # A single edge for each text first: most of a group hangs together by these.
    star = stash(shared.groupBy(F.col("id").alias("b")).agg(F.min("least").alias("a")).where("a < b"))
    edges = stash(verified(texts, star, threshold))
    first = components(edges)
    member = shared.select("band", "id").distinct().join(first, "id", "left").select("band", "id", F.coalesce("root", "id").alias("root"))
    w = Window.partitionBy("band")
    lo, hi, m = F.min("root").over(w), F.max("root").over(w), F.count("*").over(w)
    split = stash(member.withColumns({"lo": lo, "hi": hi, "m": m}).where("lo < hi").select("band", "id", "root", "m"))
    ids = stash(split.select("id").distinct())
    sets = stash(_among(texts, ids, "left_semi").mapInArrow(_sets, "id long, shingles array<int>").dropDuplicates(["id"]))
    more = stash(crossing(split, sets, threshold))
    return components(first.select(F.col("root").alias("a"), F.col("id").alias("b")).union(more)) if more.head(1) else first


def groups(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, group_id, group_size, keep for each row of docs (doc_id, text, ...).

    group_id is the least doc_id of the group, keep marks the one row that stays: that of the
    least doc_id, null last, among equals any one. Defined results: a null text is never a copy
    (a group of one, kept); an empty text or one without words is a copy only of the identical
    text; repeated rows are copies of each other; an empty table gives an empty result. Other
    columns play no part, whatever their names.
    """
    rows = docs.select("doc_id", text_id("text").alias("id"))
    member = roots(docs.where("text is not null").select(text_id("text").alias("id"), "text"), threshold)
    keyed = rows.where("id is not null").join(member, "id", "left").select("doc_id", "id", F.coalesce("root", "id").alias("root"))
    first = keyed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "id")).alias("f"), F.count("*").alias("group_size"))
    w = Window.partitionBy("root", "doc_id", "id").orderBy(F.lit(0))
    full = keyed.withColumn("nth", F.row_number().over(w)).join(first, "root")
    same = F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("id") == F.col("f.id")) & (F.col("nth") == 1)
    found = full.select("doc_id", F.col("f.doc_id").alias("group_id"), "group_size", same.alias("keep"))
    alone = rows.where("id is null").select("doc_id", F.col("doc_id").alias("group_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("keep"))
    return found.unionByName(alone)


def drop_copies(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that groups() keeps, all columns as they came.

    Rows of an id that isn't the first of its group fall in an anti join, and of identical
    texts the first row stays; only those move. Cases as in groups().
    """
    some = docs.where("text is not null")
    rows = some.select("doc_id", text_id("text").alias("id"))
    member = roots(some.select(text_id("text").alias("id"), "text"), threshold)
    ids = member.select("id", "root").union(member.select("root", "root").distinct())
    first = rows.join(ids, "id").groupBy("id", "root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "id")).alias("f"))
    w = Window.partitionBy("root").orderBy("f")
    losing = first.withColumn("nth", F.row_number().over(w)).where("nth > 1").select("id")
    name, nth = free_name(docs, "text_id"), free_name(docs, "nth")
    losing = stash(losing.withColumnRenamed("id", name))
    copied = stash(rows.groupBy(F.col("id").alias(name)).count().where("count > 1").select(name).join(losing, name, "left_anti"))
    keyed = some.withColumn(name, text_id("text"))
    plain = _among(keyed, stash(losing.union(copied)), "left_anti")
    order = Window.partitionBy(name).orderBy(F.col("doc_id").asc_nulls_last())
    firsts = _among(keyed, copied, "left_semi").withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1)
    kept = plain.select(*own(docs)).unionByName(firsts.select(*own(docs)))
    return kept.unionByName(docs.where("text is null"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))
