"""Shared plumbing: table paths, the shared folder, stable sampling."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in spark.checkpoint.dir.

    Only a local master, where every task runs on this machine, may leave it unset.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    global _LOCAL
    _LOCAL = _LOCAL or "file://" + tempfile.mkdtemp(prefix="quillmill-")
    return _LOCAL


_LOCAL: str | None = None


def stash(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again.

    Cuts the lineage with a table that survives the loss of executors, and gives the
    optimiser the true size for its choice of join. Files go when the driver ends with its
    session open; of a session stopped before, they go with the shared folder.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stash-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None or spark.sparkContext._jsc is None:  # stopped before: a local folder can still go
        if _LOCAL and path.startswith(_LOCAL):
            shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)
        return
    try:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001 - the session is going away; the folder's owner cleans up
        pass


_SCAN = re.compile(r"^[\s+:\-]*(Project|Relation|LogicalRDD|Filter)\b")


def steady(df: DataFrame) -> DataFrame:
    """df as a plan whose partitions and the order of rows in them come back the same when a task is run again:
    a plain scan as it is, anything else from a checkpoint."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    if all(_SCAN.match(line) for line in plan.splitlines() if line.strip()):
        return df
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def bound_batches(df: DataFrame) -> DataFrame:
    """df, with the session's batches to Python bounded by rows and bytes where the session doesn't say.

    Spark's own bound is 10 000 rows of whatever length, held several times over on both sides.
    """
    for k, v in BATCH.items():
        if df.sparkSession.conf.get(k, None) is None:
            df.sparkSession.conf.set(k, v)
    return df


def fraction(*cols: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1) fixed by seed and the columns' values."""
    h = F.xxhash64(F.lit(seed), *cols)
    return F.shiftrightunsigned(h, 11).cast("double") * F.lit(2.0**-53)


def free_name(df: DataFrame, wanted: str) -> str:
    """wanted, with underscores added until no column of df has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def own(df: DataFrame) -> list[Column]:
    """df's columns by their quoted names, so that a dot, a star or a backtick is part of a name."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def labelled(spark: SparkSession, sf_dir: str, label: str, bound: int, seed: int = 11) -> DataFrame:
    """At most bound rows of documents with a 0/1 label, as columns of documents and "y".

    The labels of least hash are taken, whatever their order; null and other values don't
    count. The sample has bound rows at most, so broadcasting it is safe at any size. Where a doc_id has several
    documents or labels, their pairs are rows, of which again the bound of least hash are taken.
    """
    marks = table(spark, sf_dir, "labels").where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    least = least_hashed(marks.select("doc_id", F.col(label).cast("double").alias("y")), bound, marks.count(), seed, "doc_id", "y")
    docs = table(spark, sf_dir, "documents")
    pairs = docs.where("text is not null").join(F.broadcast(least), "doc_id")
    count = docs.select("doc_id").join(F.broadcast(least), "doc_id").count()  # ids alone are read
    return pairs if count <= bound else least_hashed(pairs, bound, count, seed, "doc_id", "y", "text")


def least_hashed(rows: DataFrame, bound: int, count: int, seed: int, *cols: str) -> DataFrame:
    """The bound rows of count (or some more) with the least hash of cols, in its order.

    Rows above a share of the hash's range that leaves bound rows with certainty in practice
    fall in place, so what meets in one task doesn't grow with the table.
    """
    share = min(1.0, (bound + 8 * bound**0.5 + 8) / max(count, 1))
    return rows.where(fraction(*cols, seed=seed) < share).orderBy(F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11), *cols).limit(bound)
