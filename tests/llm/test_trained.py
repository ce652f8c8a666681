"""The trained models: accuracy on held-out labels, equality with plain scoring, odd rows."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmill.llm import quality_fm as FM
from quillmill.llm import quality_rules as QR
from quillmill.llm import toxicity as TX
from quillmill.llm.boosting import constant
from quillmill.llm.bytekernel import mix, slices, word_hash
from quillmill.llm.common import labelled
from quillmill.llm.docstats import LOWERS, NAMES
from tests.llm.helpers import DOCS, empty, odd, write

SF = "/root/testdata/sf0.1"
CLASH = ("quality_score", "toxicity", "keep", "toxic", "c0", "y", "x")


@pytest.fixture(scope="module")
def held_out(spark):
    """Labels the models of 1 000 rows haven't seen, some thousands."""

    def rows(label):
        seen = labelled(spark, SF, label, 1000).select("doc_id")
        marks = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col(label).alias("y"))
        return spark.read.parquet(f"{SF}/documents.parquet").join(marks, "doc_id").join(seen, "doc_id", "left_anti")

    return rows


@pytest.mark.parametrize("module", [QR, FM])
def test_quality_on_held_out_labels(spark, held_out, module):
    got = module.judge(held_out("quality"), module.train(spark, SF, 1000)).join(held_out("quality").select("doc_id", "y"), "doc_id").collect()
    good, bad = [r.keep for r in got if r.y == 1], [r.keep for r in got if r.y == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.2


def test_toxicity_on_held_out_labels(spark, held_out):
    got = TX.judge(held_out("toxic"), TX.train(spark, SF, 1000)).join(held_out("toxic").select("doc_id", "y"), "doc_id").collect()
    toxic, clean = [r.toxic for r in got if r.y == 1], [r.toxic for r in got if r.y == 0]
    assert np.mean(clean) < 0.01 and np.mean(toxic) > 0.55  # part of these labels is noise on clean texts
    flagged = [r.y for r in got if r.toxic]
    assert np.mean(flagged) > 0.95


LEXICON = {("word", "idiot"): 3.0, ("word", "schäbig"): 2.0, (4, "stup"): 2.75, (5, "moron"): 4.0, ("word", "dumbass"): 3.5}


def plain_features(text):
    """The features with loops over words and bytes."""
    text = text or ""
    low, raw = text.lower(), text.encode()
    fold = dict(zip("013457@$!|", "oieastasii", strict=True))
    exact, any_, hidden, you, single = [], [], [], [], []
    joined = [(m.start(), m.end()) for m in re.finditer(r"[a-z0-9@$!|\x80-\U0010ffff]+", low)]
    for m in re.finditer(r"[a-z0-9\x80-\U0010ffff]+", low):
        w = m.group()
        b = w.encode()
        run = next(low[i:j] for i, j in joined if i <= m.start() < j)
        exact.append(LEXICON.get(("word", w), 0))
        masked = LEXICON.get(("word", "".join(fold.get(c, c) for c in run)), 0)
        hidden.append(masked > exact[-1])
        any_.append(max([exact[-1], masked] + [LEXICON.get((k, b[:k].decode(errors="replace")), 0) for k in (4, 5) if len(b) >= k]))
        you.append(w in TX.YOU)
        single.append(len(b) == 1)
    n, chars = max(len(any_), 1), max(len(raw), 1)
    hit = [a > 0 for a in any_]
    near = [h and any(you[max(0, i - TX.NEAR) : i + TX.NEAR + 1]) for i, h in enumerate(hit)]
    letter = [chr(c).isalpha() or c >= 128 for c in raw]
    mark = [chr(c) in "@$!*+#%&" for c in raw]
    odd_ = [m or chr(c).isdigit() and c < 128 for m, c in zip(mark, raw, strict=True)]
    inside = sum(letter[i - 1] and odd_[i] and letter[i + 1] for i in range(1, len(raw) - 1))
    upper, cased = sum(65 <= c <= 90 for c in raw), sum(65 <= c <= 90 or 97 <= c <= 122 for c in raw)
    bang = [c in b"!?" for c in raw]
    doubled = sum(a and b for a, b in zip(bang, bang[1:], strict=False))
    return [sum(hit), sum(hit) / n, sum(any_), sum(any_) / n, sum(hidden) / n, sum(near) / n, sum(single) / n, upper / max(cased, 1), sum(bang) / chars, doubled / chars, sum(mark) / chars, inside / chars, np.log1p(len(any_))]


def lexicon_model():
    h = {int(mix(np.array([word_hash(w) ^ k], np.uint64))[0]) if isinstance(k, int) else word_hash(w): v for (k, w), v in LEXICON.items()}
    keys = sorted(h)
    return TX.Model(np.array(keys, np.uint64), np.array([h[k] for k in keys]), constant(0.5), np.zeros(0), np.zeros(0))


def test_toxic_features_against_loops(spark, sf):
    texts = ["You IDIOT!! you are stüpid, stupid2", "an 1d10t, i d i o t, $tup1d!", "moronic at a distance of one two three four five you", "!", "!?", "a1", "b", None, "", "x@y a+b", "dumb@$$ du dumba$$", "schäbig!"]
    docs = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    for batch in (texts, texts[::-1], docs):
        got = np.concatenate([lexicon_model().features(s) for s in slices(pa.array(batch, pa.string()))])
        assert np.allclose(got, [plain_features(t) for t in batch], rtol=1e-5, atol=1e-6)


def test_conflicting_labels_are_averaged(spark, tmp_path):
    """Equal texts of unlike labels: the model doesn't hang on the order of rows."""
    texts = [f"{'vile wretch' if i % 4 == 0 else 'mild person'} number {i // 2} says so" for i in range(800)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(2000 + i, texts[0], "en", "s", 9) for i in range(6)]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(800)] + [(2000 + i, 1, i % 2) for i in range(6)]
    found = []
    for name, turn in (("a", 1), ("b", -1)):
        folder = write(spark.createDataFrame(rows[::turn], DOCS), tmp_path / name, "documents")
        write(spark.createDataFrame(labels[::turn], "doc_id long, quality int, toxic int"), tmp_path / name, "labels")
        m = TX.train(spark, folder)
        found.append((m.hashes.tolist(), m.trees.value.tolist(), m.values.tolist()))
    assert found[0] == found[1] and found[0][0]


def test_repeated_documents_keep_the_bound(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(20)
    folder = write(docs.crossJoin(spark.range(30)).drop("id"), tmp_path, "documents")
    write(docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")), tmp_path, "labels")
    assert labelled(spark, folder, "quality", 50).count() == 50


def test_trained_the_same_twice(spark, sf):
    a, b = QR.train(spark, sf), QR.train(spark, sf)
    assert np.array_equal(a.threshold, b.threshold) and np.array_equal(a.value, b.value)
    a, b = FM.train(spark, sf), FM.train(spark, sf)
    assert np.array_equal(a.v, b.v)
    a, b = TX.train(spark, sf), TX.train(spark, sf)
    assert np.array_equal(a.hashes, b.hashes) and np.array_equal(a.values, b.values)


def test_machine_equals_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    m = FM.Machine(0.3, rng.normal(size=FM.DIM).astype(np.float32), rng.normal(size=(FM.DIM, FM.RANK)).astype(np.float32), np.zeros((len(NAMES), FM.LEVELS - 1), np.float32))
    off, f, x = m.rows(rng.normal(size=(3, len(NAMES))).astype(np.float32), np.array([0, 3, 3, 7]), np.array([5, 9, 70, 1, 2, 3, 4]), np.tile([FM._META, FM._META + 5], (3, 1)))
    for i, z in enumerate(m.margin(off, f, x)):
        w, ids = x[off[i] : off[i + 1]], f[off[i] : off[i + 1]]
        pairs = sum(m.v[ids[a]] @ m.v[ids[b]] * w[a] * w[b] for a in range(len(ids)) for b in range(a))
        assert z == pytest.approx(0.3 + m.w[ids] @ w + pairs, rel=1e-3, abs=1e-2)


def test_quality_rules_are_monotonic(spark):
    t = QR.train(spark, SF, 1000)
    rng = np.random.default_rng(1)
    x = rng.uniform(0, 1, (500, len(NAMES))).astype(np.float32)
    for name in LOWERS:
        y = x.copy()
        y[:, NAMES.index(name)] += 0.5
        assert (t.margin(y) <= t.margin(x) + 1e-9).all()


def test_lexicon_against_plain_counts(spark, tmp_path):
    rows = [(i, f"plain words here {i} " + ("you vileword ok" if i % 10 == 0 else "fine vileword ok" if i % 5 == 0 else "fine you ok" if i % 2 else "fine ok"), "en", "s", 0) for i in range(200)]
    write(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), tmp_path, "documents")
    write(spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(200)], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    m = TX.train(spark, str(tmp_path))
    from quillmill.llm.bytekernel import word_hash

    assert word_hash("vileword") in m.hashes.tolist() and word_hash("plain") not in m.hashes.tolist() and word_hash("ok") not in m.hashes.tolist()
    texts = pa.array(["you vileword", "V1LEW0RD now", "vilewords", "a fine text", "", None])
    p = np.concatenate([m.probability(s) for s in slices(texts)])
    assert (p[:3] > 0.5).all() and (p[3:] < 0.5).all()


@pytest.mark.parametrize("module,drop", [(QR, QR.keep_good), (FM, FM.keep_good), (TX, TX.drop_toxic)])
def test_cases(spark, sf, module, drop):
    model = module.train(spark, sf)
    docs = odd(spark, CLASH)
    got = module.judge(docs, model).collect()
    assert len(got) == 11
    score, flag = ("toxicity", "toxic") if module is TX else ("quality_score", "keep")
    assert [r[score] for r in got if r.doc_id == 2] == [None, None] and not any(r[flag] for r in got if r.doc_id == 2)
    assert len({r[score] for r in got if r.doc_id == 1}) == 1
    kept = drop(docs, model)
    assert kept.columns == docs.columns
    stay = Counter(r.doc_id for r in got if (not r[flag] if module is TX else r[flag]))
    assert Counter(r.doc_id for r in kept.collect()) == stay
    assert module.judge(empty(spark), model).count() == 0 and drop(empty(spark), model).count() == 0


@pytest.mark.parametrize("labels", ["", "(1, 1, 0)"])
@pytest.mark.parametrize("module", [QR, FM, TX])
def test_no_or_one_sided_labels(spark, tmp_path, module, labels):
    write(odd(spark), tmp_path, "documents")
    schema = "doc_id long, quality int, toxic int"
    write(spark.createDataFrame([(1, 1, 0)] if labels else [], schema), tmp_path, "labels")
    got = module.query(spark, str(tmp_path)).where("doc_id = 1").collect()
    assert all(r.toxic is False for r in got) if module is TX else all(r.keep for r in got)
