"""Which model fits a host: a range join to a small catalogue, first fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: For each role, options best first with the least memory in GB; a deployment passes its own.
CATALOG = {
    "orchestrator": [("large", 24.0), ("medium", 12.0), ("small", 7.0)],
    "vision": [("primary", 8.0), ("fallback", 7.0)],
}


def first_fit(hosts: DataFrame, keys: list[str], catalog: dict[str, list[tuple[str, float]]] = CATALOG) -> DataFrame:
    """keys, role, option: the first option whose least memory total_gb covers, else the role's last.

    The catalogue is a constant of the program, so sending it to every executor is safe.
    """
    spark = hosts.sparkSession
    rows = [(role, i, name, least, i == len(options) - 1) for role, options in catalog.items() for i, (name, least) in enumerate(options)]
    options = spark.createDataFrame(rows, "role string, rank int, option string, least double, last boolean")
    fits = hosts.join(F.broadcast(options), (F.col("total_gb") >= F.col("least")) | F.col("last"))
    return fits.groupBy(*keys, "role").agg(F.min_by("option", "rank").alias("option"))


def suitability(vram: Column, ram: Column, need_vram: Column, need_ram: Column) -> Column:
    """struct(backend, status): GPU if it fits there, else split with main memory, else CPU, else nothing."""
    backend = F.when(vram >= need_vram, "GPU").when((vram > 0) & (vram + ram >= need_vram), "auto-split").when(ram >= need_ram, "CPU").otherwise("")
    return F.struct(backend.alias("backend"), F.when(backend == "", "unavailable").otherwise("ready").alias("status"))


def tier_label(total: Column) -> Column:
    return F.when(total >= 30, "High").when(total >= 24, "Mid").otherwise("Min spec")
