"""Toxicity: boosted trees over dense features of the whole text, with isotonic calibration.

Everything is trained on labels.toxic, at most TRAIN_ROWS of them: first the lexicon, words
and word beginnings whose document counts among toxic and clean texts differ past chance
(a G test) and by a wide margin; then the trees on its densities, second-person proximity,
capitals, punctuation and obfuscation rates; then, on rows held out from both, the calibration.
The lexicon is a set of 64-bit hashes, so no word list is kept in the code.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.boosting import Trees, constant, fit, isotonic, sigmoid, step
from quillmill.llm.bytekernel import _U, DIGIT, HIGH, LOWER, UPPER, WORD, Slice, Words, _class, mix, row_sums, runs, slices, span_hash, word_hash, words
from quillmill.llm.common import bound_batches, free_name, labelled, stash, table
from quillmill.llm.quality_rules import scored

TRAIN_ROWS, HELD_OUT, REJECT = 20_000, 0.25, 0.5
#: A lexicon entry's least G statistic and log ratio of rates.
G_LEAST, RATIO_LEAST = 25.0, 2.5
NEAR = 4
YOU = "you your yours yourself u ur du dich dir dein deine deiner ihr euch euer sie ihnen tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros os su sus".split()

_LETTER, _MARK = UPPER | LOWER | HIGH, _class("@$!*+#%&")
_JOINED = WORD | _class("@$!|")
_FOLD = np.arange(256, dtype=np.uint8)
for _a, _b in zip(b"013457@$!|", b"oieastasii", strict=True):
    _FOLD[_a] = _b


def forms(s: Slice, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each word: its hash, those of its first 4 and 5 bytes (0 if shorter), and that of the
    word with look-alike digits and signs read as letters, which may reach past the word."""
    out = [w.hash]
    for k in (4, 5):
        h = span_hash(s.low, w.start, np.minimum(w.start + k, w.end))
        out.append(np.where(w.end - w.start >= k, mix(h ^ _U(k)), _U(0)))
    start, end = runs(_JOINED[s.low], s.low_off)
    which = np.searchsorted(start, w.start, "right") - 1
    out.append(span_hash(_FOLD[s.low], start, end)[which] if len(start) else w.hash)
    return tuple(out)


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each hash of a word or beginning, how many toxic and clean texts of the partition have it."""
    h, a, b = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)
    for batch in batches:
        y = batch.column("y").to_numpy()
        for s in slices(batch.column("text")):
            w = words(s)
            seen = np.concatenate(forms(s, w)[:3])
            doc = np.tile(w.doc, 3)[seen != 0]
            seen = seen[seen != 0]
            order = np.lexsort((seen, doc))
            doc, seen = doc[order], seen[order]
            new = np.r_[True, (doc[1:] != doc[:-1]) | (seen[1:] != seen[:-1])][: len(seen)]
            mark = y[s.first + doc[new]]
            h, at = np.unique(np.concatenate([h, seen[new]]), return_inverse=True)
            a, b = (np.bincount(at, np.concatenate([c, m]), len(h)) for c, m in ((a, mark), (b, 1 - mark)))
    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(a), pa.array(b)], ["h", "a", "b"])


def lexicon(counts: DataFrame, toxic: float, clean: float) -> DataFrame:
    """h, ratio of the entries among counts (h, a, b: toxic and clean texts with it)."""
    a, b = F.col("a"), F.col("b")
    ratio = F.log((a + 0.5) / (toxic + 1)) - F.log((b + 0.5) / (clean + 1))
    share = toxic / (toxic + clean)
    term = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    g = 2 * (term(a, (a + b) * share) + term(b, (a + b) * (1 - share)))
    return counts.where((g >= G_LEAST) & (ratio >= RATIO_LEAST)).select("h", ratio.alias("ratio"))


@dataclass
class Model:
    hashes: np.ndarray
    ratios: np.ndarray
    trees: Trees
    knots: np.ndarray
    values: np.ndarray

    def weight(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(h))
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.ratios[at], 0.0)

    def features(self, s: Slice) -> np.ndarray:
        w = words(s)
        plain, four, five, folded = forms(s, w)
        exact, hidden = self.weight(plain), self.weight(folded)
        begun = np.maximum(self.weight(four), self.weight(five))
        # A word counts once, however it is found, so disguises unseen in training weigh the same.
        any_ = np.maximum(np.maximum(exact, hidden), begun)
        hit = any_ > 0
        n = np.maximum(np.diff(w.off), 1)
        rate = lambda v: row_sums(v.astype(float), w.off) / n
        total = np.r_[0, np.cumsum(np.isin(plain, _YOU_HASHES))]
        lo, hi = np.maximum(np.arange(len(hit)) - NEAR, w.off[w.doc]), np.minimum(np.arange(len(hit)) + NEAR + 1, w.off[w.doc + 1])
        near = hit & (total[hi] - total[lo] > 0)
        chars = np.maximum(np.diff(s.raw_off), 1)
        share = lambda m: row_sums(m.astype(np.int64), s.raw_off) / chars
        raw = s.raw
        letter, mark, digit = _LETTER[raw], _MARK[raw], DIGIT[raw]
        inside = np.zeros(len(raw), bool)
        inside[1:-1] = letter[:-2] & (mark | digit)[1:-1] & letter[2:]
        upper, lower = UPPER[raw], LOWER[raw]
        bang = (raw == 33) | (raw == 63)
        doubled = np.zeros(len(raw), bool)
        doubled[1:] = bang[1:] & bang[:-1]
        edge = np.concatenate([s.raw_off[:-1], s.raw_off[1:] - 1])[np.tile(np.diff(s.raw_off) > 0, 2)]
        inside[edge] = False  # what a text's first and last bytes are doesn't hang on its neighbours
        doubled[edge[: len(edge) // 2]] = False
        single = (w.end - w.start) == 1
        return np.column_stack([
            row_sums(hit.astype(np.int64), w.off), rate(hit), row_sums(any_, w.off), rate(any_), rate(hidden > exact), rate(near), rate(single),
            row_sums(upper.astype(np.int64), s.raw_off) / np.maximum(row_sums((upper | lower).astype(np.int64), s.raw_off), 1),
            share(bang), share(doubled), share(mark), share(inside), np.log1p(np.diff(w.off)),
        ]).astype(np.float32)

    def probability(self, s: Slice) -> np.ndarray:
        return step(self.knots, self.values, sigmoid(self.trees.margin(self.features(s))))


_YOU_HASHES = np.array([word_hash(x) for x in YOU], np.uint64)


def train(spark: SparkSession, sf_dir: str, rows: int = TRAIN_ROWS) -> Model:
    """Without labels of both kinds, a model that calls nothing toxic. Equal texts are one row, labelled by their mean.

    Texts and word counts stay with the executors; the lexicon and a row of features for each
    text come to the driver.
    """
    # Of equal texts with unlike labels, the mean: no row's turn decides.
    sample = bound_batches(labelled(spark, sf_dir, "toxic", rows)).groupBy("text").agg(F.avg("y").alias("y"))
    sample = stash(sample.withColumn("held", F.pmod(F.xxhash64(F.lit(5), "text"), F.lit(1000)) < int(1000 * HELD_OUT)))
    nothing = Model(np.zeros(0, np.uint64), np.zeros(0), constant(0.0), np.zeros(0), np.zeros(0))
    learn = sample.where("not held")
    toxic, clean = learn.agg(F.coalesce(F.sum("y"), F.lit(0.0)), F.coalesce(F.sum(1 - F.col("y")), F.lit(0.0))).first()
    if not toxic or not clean:
        return nothing
    counts = learn.mapInArrow(_seen, "h long, a double, b double").groupBy("h").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    found = lexicon(counts, toxic, clean).toArrow()
    hashes, ratios = found.column("h").to_numpy().view(np.uint64), found.column("ratio").to_numpy()
    order = np.argsort(hashes)
    model = Model(hashes[order], ratios[order], constant(0.0), np.zeros(0), np.zeros(0))

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b.column("text")):
                x = model.features(s)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(s.n + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(s.first, s.n) for c in ("y", "held")), lists], ["y", "held", "x"])

    got = sample.mapInArrow(dense, "y double, held boolean, x array<float>").toArrow()
    y, held = got.column("y").to_numpy(), np.asarray(got.column("held").to_numpy(zero_copy_only=False), bool)
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(len(y), -1)
    order = np.lexsort(np.vstack([x.T, y]))  # rows come in any order; the model doesn't follow it
    y, held, x = y[order], held[order], x[order]
    model.trees = fit(x[~held], y[~held], trees=60, depth=3, least=1.0)
    if held.any() and y[held].any():
        model.knots, model.values = isotonic(sigmoid(model.trees.margin(x[held])), y[held])
    return model


def scores(docs: DataFrame, model: Model, name: str = "toxicity") -> DataFrame:
    def score(text: pa.Array) -> Iterator[np.ndarray]:
        for s in slices(text):
            yield model.probability(s)

    return scored(docs, name, ["text"], score)


def judge(docs: DataFrame, model: Model, reject: float = REJECT) -> DataFrame:
    """doc_id, toxicity (calibrated probability), toxic for each row of docs (doc_id, text, lang, source, ...).

    Defined results: a null text has a null probability and isn't toxic; an empty text is
    scored as one without words; repeated rows get equal results; an empty table gives an empty
    result; nulls in other columns and further columns of any name change nothing.
    """
    return scores(docs.select("doc_id", "text"), model).drop("text").withColumn("toxic", F.coalesce(F.col("toxicity") >= reject, F.lit(False)))


def drop_toxic(docs: DataFrame, model: Model, reject: float = REJECT) -> DataFrame:
    """The rows of docs that judge() doesn't call toxic, with their columns; a null text stays."""
    name = free_name(docs, "toxicity")
    return scores(docs, model, name=name).where(F.coalesce(F.col(name), F.lit(0.0)) < reject).drop(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), train(spark, sf_dir))
