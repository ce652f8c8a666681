"""A training corpus from raw documents: five stages, each written as Parquet and read by the next.

The trained stages learn from the tables of sf_dir (documents with labels) and are applied to
all rows that their predecessor kept.

Defined results for every stage: rows with nulls in any column, empty and very long texts, ties and repeated rows
are rows like others unless the stage says below what becomes of them; an empty table gives an empty table of the
same columns (pack: of its own); further columns of any name come through every stage but the last unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillmill.llm import mixing, near_dedup, packing, quality_rules, toxicity
from quillmill.llm.common import own, stash, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the rows called toxic. A null text isn't toxic; an empty one is scored as one without words; equal rows fare alike."""
    return toxicity.drop_toxic(docs, toxicity.train(spark, sf_dir))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the rows of poor quality. A null text goes; an empty one is scored as one without words; equal rows fare alike."""
    return quality_rules.keep_good(docs, quality_rules.train(spark, sf_dir))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that of the least doc_id, null last. Null texts stay; of repeated rows any one does."""
    return near_dedup.drop_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows served within the budget of tokens, in order of finish time. A null source is a source of its own; rows equal in
    source, doc_id and text, and ties in time and key, are served or cut together."""
    return mixing.mix_sources(docs).select(*own(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of docs. A null or empty text is a piece of no tokens; repeated rows are packed each."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("quality_rules", keep_good),
    ("near_dedup", drop_copies),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: Trained models and signatures are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
