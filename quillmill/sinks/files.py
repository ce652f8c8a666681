"""Writing markdown, reports and the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_markdown(docs: DataFrame, path: str) -> None:
    """docs (doc, md): a folder doc=... with its markdown for each document; what an earlier run wrote for others stays."""
    docs.select("doc", "md").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("lineSep", "\n").partitionBy("doc").text(path)


def write_flagged(reports: DataFrame, parsed: DataFrame, path: str) -> None:
    """reports (doc, report) of the documents parsed (doc) just now: theirs replace, and a stale one of those without a report is deleted."""
    spark = reports.sparkSession
    fs, root = _fs(spark, path)
    if fs.exists(root):
        # Only documents that had a report come to the driver, and of those only the ones that lost it.
        had = [(s.getPath().getName().partition("=")[2],) for s in fs.listStatus(root) if s.isDirectory() and s.getPath().getName().startswith("doc=")]
        old = spark.createDataFrame(had, "__dir string").withColumn("doc", F.url_decode(F.replace("__dir", F.lit("+"), F.lit("%2B"))))
        gone = old.join(parsed.select("doc").distinct(), "doc", "left_semi").join(reports.select("doc"), "doc", "left_anti")
        for row in gone.collect():
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(root, f"doc={row['__dir']}"), True)
    reports.select("doc", "report").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc").text(path)


def save_registry(registry: DataFrame, path: str) -> None:
    """Written beside, then swapped in by renames. One writer; wherever it stops, recover() finds the old or the new table whole."""
    spark = registry.sparkSession
    recover(spark, path)
    registry.write.mode("overwrite").parquet(f"{path}.new")
    fs, to = _fs(spark, path)
    new, old = (spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{x}") for x in ("new", "old"))
    if fs.exists(to):
        fs.delete(old, True)
        fs.rename(to, old)
    fs.rename(new, to)
    fs.delete(old, True)


def recover(spark: SparkSession, path: str) -> None:
    """Puts back the table that a writer stopped between two renames: the new one if it was written to its end, else the old one."""
    fs, to = _fs(spark, path)
    if fs.exists(to):
        return
    at = spark._jvm.org.apache.hadoop.fs.Path
    if fs.exists(at(f"{path}.new/_SUCCESS")):
        fs.rename(at(f"{path}.new"), to)
    elif fs.exists(at(f"{path}.old")):
        fs.rename(at(f"{path}.old"), to)


def _fs(spark: SparkSession, path: str):
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    return to.getFileSystem(spark._jsc.hadoopConfiguration()), to
