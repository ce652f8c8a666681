"""The pipeline: each stage's decision takes effect on all its predecessor kept, by brute force, and survives odd rows."""

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline as P
from quillmill.llm import mixing, near_dedup, packing, quality_rules, toxicity
from quillmill.llm.boosting import sigmoid
from quillmill.llm.bytekernel import slices, words
from quillmill.llm.docstats import structure
from quillmill.llm.tokens import encoder
from tests.llm.helpers import empty, odd, write
from tests.llm.test_mixing_sharding_packing import brute_mix, brute_pack, unpacked
from tests.llm.test_near_dedup import brute


def walk(trees, x):
    """Probability of a row of features, node by node."""
    margin = trees.bias
    for at in trees.roots:
        while trees.left[at] != at:
            at = trees.left[at] if x[trees.feature[at]] <= trees.threshold[at] else trees.right[at]
        margin += trees.value[at]
    return float(sigmoid(np.array([margin]))[0])


def alone(text):
    """The text as a slice of its own."""
    return next(slices(pa.array([text], pa.string())))


def plain_toxic(spark, sf, rows):
    model = toxicity.train(spark, sf)

    def bad(text):
        p = walk(model.trees, model.features(alone(text))[0])
        if len(model.knots):  # the last knot that p reaches
            p = next((v for k, v in zip(model.knots[::-1], model.values[::-1], strict=True) if k <= p + 1e-12), model.values[0])
        return p >= toxicity.REJECT

    return [r for r in rows if r.text is None or not bad(r.text)]


def plain_good(spark, sf, rows):
    model = quality_rules.train(spark, sf)
    return [r for r in rows if r.text is not None and walk(model, structure(s := alone(r.text), words(s))[0]) >= quality_rules.KEEP]


def plain_copies(spark, sf, rows):
    rows = sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0))
    group = brute([(r.doc_id, r.text) for r in rows], near_dedup.THRESHOLD)
    return [r for i, r in enumerate(rows) if group[i] == i]


def plain_mix(spark, sf, rows):
    served = brute_mix([(r.doc_id, r.text, r.source) for r in rows], mixing.WEIGHTS, mixing.BUDGET)
    return [rows[i] for i in served]


SF = "/root/testdata/sf0.01"  # enough labels for a toxic lexicon
PLAIN = {"toxicity": plain_toxic, "quality_rules": plain_good, "near_dedup": plain_copies, "mix_sources": plain_mix}


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The stages' inputs and outputs as the driver makes them: written and read again."""
    sf, out = SF, []
    folder = tmp_path_factory.mktemp("steps")
    at = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in P.STAGES:
        stage(spark, at, sf).write.parquet(f"{folder}/{name}")
        done = spark.read.parquet(f"{folder}/{name}")
        out.append((name, at, done))
        at = done
    return out


@pytest.mark.parametrize("at", range(4))
def test_stage_against_brute_force(spark, steps, at):
    name, docs, got = steps[at]
    assert got.columns == docs.columns
    want = Counter(map(tuple, PLAIN[name](spark, SF, docs.collect())))
    assert Counter(map(tuple, got.collect())) == want and 0 < want.total() < docs.count()


def test_packed_stage_against_brute_force(spark, steps):
    from pyspark.sql import functions as F

    _, docs, got = steps[4]
    rows = docs.withColumn("row", F.monotonically_increasing_id()).withColumn("g", F.expr(f"pmod(xxhash64({packing.SEED}, row), {max(1, -(-docs.count() // packing.GROUP))})")).collect()
    enc, bins, want = encoder(), got.collect(), defaultdict(list)
    for r in rows:
        want[r.g].append((r.row, r.doc_id, len(enc.encode_ordinary(r.text or ""))))
    for g in want:
        mine = sorted((b for b in bins if b.group_id == g), key=lambda b: b.bin_id)
        assert [list(zip(b.doc_ids, b.starts, b.lengths, strict=True)) for b in mine] == brute_pack(want[g], packing.CAPACITY)
    assert unpacked(enc, bins) == {r.doc_id: r.text or "" for r in rows}


def test_run_is_the_stages(spark, steps):
    key = lambda b: (tuple(b.doc_ids), tuple(b.starts))
    parts = lambda rows: Counter(p for b in rows for p in zip(b.doc_ids, b.starts, b.lengths, strict=True))
    run, stages = P.run(spark, SF).collect(), steps[4][2].collect()
    assert parts(run) == parts(stages) and all(key(b) and b.tokens == len(b.input_ids) <= packing.CAPACITY for b in run)


def test_planted_rows(spark, steps):
    """Toxic and junk texts go; clean ones stay."""
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    ids = {r.doc_id for r in steps[1][2].select("doc_id").collect()}
    good = [i for i, r in labels.items() if r.quality == 1 and r.toxic == 0]
    assert sum(i in ids for i in good) >= 0.98 * len(good)
    bad = [i for i, r in labels.items() if r.quality == 0]
    assert sum(i in ids for i in bad) <= 0.2 * len(bad)


def test_odd_and_empty_tables(spark, sf, tmp_path):
    """Odd rows beside enough labelled ones, and no rows at all."""
    labels, docs = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/documents.parquet")
    extra = odd(spark, ("tokens", "keep", "m"))
    shifted = docs.selectExpr("doc_id + 1000 AS doc_id", *docs.columns[1:], "'mine' AS tokens", "'mine' AS keep", "'mine' AS m")
    d = write(extra.unionByName(shifted), tmp_path / "odd", "documents")
    write(labels.selectExpr("doc_id + 1000 AS doc_id", "quality", "toxic"), tmp_path / "odd", "labels")
    at = spark.read.parquet(f"{d}/documents.parquet")
    for i, (name, stage) in enumerate(P.STAGES[:-1]):
        stage(spark, at, d).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        assert out.columns == at.columns
        if i == 0:  # nothing odd is toxic
            assert out.where("doc_id < 1000 OR doc_id IS NULL").count() == extra.count()
        if i == 1:
            assert out.where("text IS NULL").count() == 0
        at = out
    assert at.count() > 0
    rows = P.run(spark, d).collect()
    assert rows and {x for b in rows for x in b.doc_ids} == {r.doc_id for r in at.select("doc_id").collect()}
    d = write(empty(spark), tmp_path / "none", "documents")
    write(labels, tmp_path / "none", "labels")
    assert P.run(spark, d).collect() == []


@pytest.mark.parametrize("name", ["a.b", "a`b", "*", "text.x"])
def test_columns_of_any_name(spark, sf, tmp_path, name):
    """What a further column is called changes nothing: dots, stars and backticks are part of its name."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 40")
    named = docs.withColumn(name, F.lit("mine"))
    for step, stage in P.STAGES[2:4]:
        stage(spark, named, sf).write.parquet(f"{tmp_path}/{step}")
        out = spark.read.parquet(f"{tmp_path}/{step}")
        assert out.columns == named.columns and {r[-1] for r in out.collect()} == {"mine"}
        assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in stage(spark, docs, sf).collect())
