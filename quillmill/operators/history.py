"""Conversation history: token estimate and compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def estimate_tokens(messages: DataFrame, conv: str = "conv_id") -> DataFrame:
    return messages.groupBy(conv).agg((F.sum(F.length(F.coalesce("text", F.lit("")))).cast("long")).alias("__n")).select(conv, F.floor(F.col("__n") / 4).alias("tokens"))


def compress_history(messages: DataFrame, limit: int = 8000, tail: int = 4, summary=None) -> DataFrame:
    """conv_id, pos, role, text: long conversations as first message, a summary of the middle, and the last four.

    A conversation within the limit or of five messages at most stays. summary: a Column of the
    middle's aggregate "texts" (array) and "n_chars"; by default it says how much it stands for.
    """
    w = Window.partitionBy("conv_id")
    rows = messages.select("conv_id", "turn", "role", "text", F.count("*").over(w).alias("n"), F.floor(F.sum(F.length("text")).over(w) / 4).alias("tokens"), F.row_number().over(w.orderBy("turn")).alias("i"))
    long = (F.col("tokens") > limit) & (F.col("n") > tail + 1)
    middle = long & (F.col("i") > 1) & (F.col("i") <= F.col("n") - tail)
    kept = rows.where(~middle).select("conv_id", "i", "role", "text")
    text = F.format_string("[Prior context summary]\n%d messages, %d characters", F.count("*"), F.sum(F.length("text"))) if summary is None else summary
    short = rows.where(middle).groupBy("conv_id").agg(F.min("i").alias("i"), F.lit("system").alias("role"), text.alias("text"))
    both = kept.unionByName(short)
    return both.select("conv_id", (F.row_number().over(w.orderBy("i")) - 1).cast("long").alias("pos"), "role", "text")
