"""Quality rules: boosted trees over document statistics, flattened for vectorised scoring.

Trained here on labels.quality, at most TRAIN_ROWS of them. What only junk has much of (symbols,
shouting, echoes, repeated lines, pipes) carries a monotonic constraint: more of it never
raises a score. Scoring walks flat numpy node arrays, all rows and trees of a slice at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.boosting import Trees, constant, fit, sigmoid
from quillmill.llm.bytekernel import slices, words
from quillmill.llm.common import bound_batches, free_name, labelled, table
from quillmill.llm.docstats import LOWERS, NAMES, structure

TRAIN_ROWS, KEEP = 20_000, 0.5


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for s in slices(b.column("text")):
            x = structure(s, words(s))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(s.n + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("y").slice(s.first, s.n), lists], ["y", "x"])


def train(spark: SparkSession, sf_dir: str, rows: int = TRAIN_ROWS) -> Trees:
    """Without labels of both kinds, a model that keeps everything."""
    got = bound_batches(labelled(spark, sf_dir, "quality", rows).select("text", "y")).mapInArrow(_features, "y double, x array<float>").toArrow()
    y = got.column("y").to_numpy()
    x = got.column("x").combine_chunks().values.to_numpy().reshape(len(y), -1) if len(y) else np.zeros((0, len(NAMES)), np.float32)
    order = np.lexsort(np.vstack([x.T, y]))  # rows come in any order; the model doesn't follow it
    return fit(x[order], y[order], trees=100, depth=4, least=1.0, signs=np.array([-(n in LOWERS) for n in NAMES])) if len(set(y)) > 1 else constant(1.0)


def scored(docs: DataFrame, name: str, columns: list[str], score: Callable[..., Iterator[np.ndarray]]) -> DataFrame:
    """docs with name, what score yields for the Arrow arrays of the columns, the first of them the text; null for a null text.

    Only those columns go to Python, and only the score comes back.
    """

    @F.arrow_udf("double")
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for arrays in batches:
            found = np.concatenate([np.zeros(0), *score(*arrays)])
            yield pa.array(found, pa.float64(), mask=np.asarray(arrays[0].is_null()))

    @F.arrow_udf("double")
    def run_one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from run.func((a,) for a in batches)

    call = run_one if len(columns) == 1 else run
    return bound_batches(docs).withColumn(name, call(*[F.col(c) for c in columns]))


def scores(docs: DataFrame, model: Trees, name: str = "quality_score") -> DataFrame:
    def score(text: pa.Array) -> Iterator[np.ndarray]:
        for s in slices(text):
            yield sigmoid(model.margin(structure(s, words(s))))

    return scored(docs, name, ["text"], score)


def judge(docs: DataFrame, model: Trees, keep: float = KEEP) -> DataFrame:
    """doc_id, quality_score, keep for each row of docs (doc_id, text, lang, source, ...).

    Defined results: a null text has a null score and isn't kept; an empty text is scored as
    one without words; repeated rows get equal scores; an empty table gives an empty result;
    nulls in other columns and further columns of any name change nothing.
    """
    return scores(docs.select("doc_id", "text"), model).drop("text").withColumn("keep", F.coalesce(F.col("quality_score") >= keep, F.lit(False)))


def keep_good(docs: DataFrame, model: Trees, keep: float = KEEP) -> DataFrame:
    """The rows of docs that judge() keeps, with their columns."""
    name = free_name(docs, "quality_score")
    return scores(docs, model, name=name).where(F.col(name) >= keep).drop(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), train(spark, sf_dir))
