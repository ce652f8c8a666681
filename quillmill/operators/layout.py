"""Geometry of blocks, regions and images, and reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions import text as T


def blocks_from_lines(blocks: DataFrame) -> DataFrame:
    """Text blocks (lines: array of arrays of span texts) as block texts; image blocks keep an empty text; empty text blocks go."""
    spans = F.transform("lines", lambda line: T.strip(F.array_join(line, "")))
    joined = T.strip(F.array_join(F.filter(spans, lambda x: x != ""), "\n"))
    text = F.when(F.col("block_type") == "image", F.lit("")).otherwise(T.normalize_ligatures(joined))
    return blocks.withColumn("text", text).where((F.col("block_type") == "image") | (F.col("text") != "")).drop("lines")


def classify_region(w: Column, h: Column) -> Column:
    aspect = F.when(h > 0, w / h).otherwise(1.0)
    return F.when((aspect > 2.5) & (w > 300), "ecg").when((w > 200) & (h > 150), "diagram").otherwise("figure")


def detect_regions(blocks: DataFrame, dpi: int = 150, least_bytes: int = 5000) -> DataFrame:
    """Image blocks of half an inch or more both ways, with pixel sizes and label."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    px = lambda v: F.floor(v * dpi / 72).cast("int")
    big = blocks.where((F.col("block_type") == "image") & (w >= 36) & (h >= 36)).withColumns({"w_px": px(w), "h_px": px(h)})
    return big.where(F.col("w_px") * F.col("h_px") * 3 >= least_bytes).withColumn("label", classify_region(F.col("w_px"), F.col("h_px")))


def image_type(w: Column, h: Column) -> Column:
    aspect = F.when(h > 0, w / h).otherwise(1.0)
    return F.when((aspect > 2.5) & (w > 400), "ecg").when((w > 600) & (h > 400), "diagram").otherwise("generic")


def pdf_type(images: DataFrame, keys: list[str], docs: DataFrame) -> DataFrame:
    """keys, pdf_type: A without images of note, C with a large one, else B."""
    some = images.where((F.col("size_kb") >= 5) & (F.col("w") >= 100) & (F.col("h") >= 80)).groupBy(*keys).agg(F.bool_or(F.col("w") >= 400).alias("__large"))
    return docs.join(some, keys, "left").select(*keys, F.when(F.col("__large").isNull(), "A").when(F.col("__large"), "C").otherwise("B").alias("pdf_type"))


def crop_box(l: Column, t: Column, r: Column, b: Column, w: Column, h: Column) -> Column:
    """struct(x0, y0, x1, y1) in pixels of a box in [0, 1], null if degenerate or under 4 pixels."""
    px = lambda v, n: F.floor(v * n).cast("int")
    x0, y0, x1, y1 = px(l, w), px(t, h), px(r, w), px(b, h)
    return F.when((r > l) & (b > t) & (x1 - x0 >= 4) & (y1 - y0 >= 4), F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))


def resize_dims(w: Column, h: Column, most: int) -> Column:
    """struct(w, h) with the longer edge at most so many pixels."""
    edge = F.greatest(w, h)
    fit = lambda v: F.when(edge > most, F.floor(v * (F.lit(float(most)) / edge)).cast("int")).otherwise(v)
    return F.struct(fit(w).alias("w"), fit(h).alias("h"))


def spatial_sort(blocks: DataFrame, keys: list[str], width: Column) -> DataFrame:
    """blocks with reading_order: left column with the full-width blocks among it, then the right column."""
    spanning = F.col("x1") - F.col("x0") > width * 0.55
    left = ~spanning & ((F.col("x0") + F.col("x1")) / 2 < width / 2)
    right = ~spanning & ~left
    order = F.row_number().over(Window.partitionBy(*keys).orderBy(right.cast("int"), "y0", left.cast("int"), "ord")) - 1
    return blocks.withColumn("reading_order", order.cast("long"))


def layout_order(elements: DataFrame, keys: list[str]) -> DataFrame:
    """elements (label, l, t, r, b, pos) without page headers and footers, boxes held to [0, 1], ord by top, then left."""
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c)))
    kept = elements.where(~F.col("label").isin("page_header", "page_footer")).withColumns({c: clamp(c) for c in "ltrb"})
    return kept.withColumn("ord", F.row_number().over(Window.partitionBy(*keys).orderBy("t", "l", "pos")) - 1)
