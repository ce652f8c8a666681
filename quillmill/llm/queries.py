"""One query for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillmill.llm import ann, chat, html_cut, mixing, near_dedup, packing, quality_fm, quality_rules, sharding, toxicity


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # the script at the repository's top; the package itself needs no such path

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_fm": quality_fm.query,
    "op2_near_dedup": near_dedup.query,
    "op3_chat_windows": chat.query,
    "op4_html_min_cut": html_cut.query,
    "op5_nearest_neighbours": ann.query,
    "op6_toxicity": toxicity.query,
    "op7_mix_sources": mixing.query,
    "op8_shard": sharding.query,
    "op9_pack": packing.query,
    "op10_quality_rules": quality_rules.query,
    "pipeline": pipeline,
}
ORACLES: dict[str, str] = {"op7_mix_sources": mixing.SQL}
