"""The registry of documents: one row a key, with status and times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PENDING, PROCESSING, DONE, FLAGGED, ERROR = "pending", "processing", "done", "flagged", "error"
ORDER = {ERROR: 0, FLAGGED: 1, DONE: 2, PROCESSING: 3, PENDING: 4}
SCHEMA = T.StructType([
    T.StructField("pdf", T.StringType()), T.StructField("added", T.TimestampType()), T.StructField("status", T.StringType()), T.StructField("last_parsed", T.TimestampType()),
    T.StructField("score", T.DoubleType()), T.StructField("pages", T.LongType()), T.StructField("flagged_pages", T.LongType()), T.StructField("error", T.StringType()),
])


def key(path: Column, workspace: Column) -> Column:
    """The path within the workspace, else the path as it is."""
    base = F.concat(F.regexp_replace(workspace, r"/+$", ""), F.lit("/"))
    return F.when(path.startswith(base), F.substring(path, F.length(base) + 1, F.length(path))).otherwise(path)


def upsert(registry: DataFrame, changes: DataFrame, fields: list[str], now: Column) -> DataFrame:
    """registry merged with changes (pdf and fields): a supplied field overwrites, with null too; other columns stay; new keys get added = now."""
    new = changes.select("pdf", F.lit(True).alias("__new"), *[F.col(c).alias(f"__{c}") for c in fields])
    both = registry.withColumn("__old", F.lit(True)).join(new, "pdf", "full_outer")
    pick = {c: F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)) for c in fields}
    if "added" not in fields:
        pick["added"] = F.when(F.col("__old").isNull(), now).otherwise(F.col("added"))
    return both.withColumns(pick).select(*registry.columns)


def remove(registry: DataFrame, keys: DataFrame) -> DataFrame:
    return registry.join(keys.select("pdf").distinct(), "pdf", "left_anti")


def by_status(registry: DataFrame, *statuses: str) -> DataFrame:
    return registry.where(F.col("status").isin(*statuses))


def done(registry: DataFrame) -> DataFrame:
    return by_status(registry, DONE, FLAGGED)


def flagged(registry: DataFrame) -> DataFrame:
    return registry.where((F.col("status") == FLAGGED) | (F.coalesce("flagged_pages", F.lit(0)) > 0))


def discover(found: DataFrame, registry: DataFrame) -> DataFrame:
    """Keys found (pdf) that the registry doesn't have, sorted."""
    return found.select("pdf").distinct().join(registry.select("pdf"), "pdf", "left_anti").orderBy("pdf")


def mark_pending(found: DataFrame, registry: DataFrame, now: Column) -> DataFrame:
    return upsert(registry, discover(found, registry).withColumn("status", F.lit(PENDING)), ["status"], now)


def rank(status: Column) -> Column:
    out = F.lit(5)
    for s, n in ORDER.items():
        out = F.when(status == s, n).otherwise(out)
    return out


def listing(registry: DataFrame) -> DataFrame:
    """By what needs attention first, then the longest unparsed."""
    return registry.orderBy(rank(F.col("status")), F.col("last_parsed").asc_nulls_first(), "pdf")


def counts(registry: DataFrame) -> DataFrame:
    return registry.groupBy("status").count().orderBy("status")


def latest(events: DataFrame, by: str, at: str) -> DataFrame:
    """The last row of each key of a status log, by time, then the whole row."""
    rest = [c for c in events.columns if c not in (by, at)]
    last = events.groupBy(by).agg(F.max(F.struct(at, *rest)).alias("r"))
    return last.select(by, "r.*")
