"""Continuous discovery of files, and stalls in an event log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillmill.operators import registry as Y
from quillmill.sinks.files import save_registry
from quillmill.sources.files import load_registry

_FILES = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """A stream of pdf, size for the files that arrive below a folder; contents aren't read."""
    files = spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select(F.regexp_replace("path", "^file:/*", "/").alias("pdf"), F.col("length").alias("size"))


def track(found: DataFrame, registry: str, checkpoint: str, on_new: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Adds each key of the stream to the registry as pending, once: a batch that is run again finds its keys there."""

    def batch(rows: DataFrame, _: int) -> None:
        # The registry's own session: a batch has a cloned one.
        known = load_registry(rows.sparkSession, registry)
        new = Y.discover(rows, known)
        if new.isEmpty():
            return
        if on_new is not None:
            on_new(new)
        save_registry(Y.mark_pending(rows, known, F.current_timestamp()), registry)

    return found.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stalls(events: DataFrame, by: str, at: str, seconds: int = 150) -> DataFrame:
    """by, since, seconds: the gaps between a key's events that are longer than so many seconds."""
    before = F.lag(at).over(Window.partitionBy(by).orderBy(at))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    rows = events.select(by, before.alias("since"), (micros(F.col(at)) - micros(before)).alias("gap"))
    return rows.where(F.col("gap") > seconds * 1_000_000).select(by, "since", F.floor(F.col("gap") / 1_000_000).alias("seconds"))


def live_sessions(events: DataFrame, by: str, at: str, seconds: int = 150, late: str = "10 minutes") -> DataFrame:
    """by, start, end, n of each key's runs of events without such a gap; works on streams, which drop what comes too late."""
    window = F.session_window(at, f"{seconds} seconds")
    return events.withWatermark(at, late).groupBy(window.alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
