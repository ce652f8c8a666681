"""Profiles of pages and documents, and the plan made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.parity import EXAM

PAGE_TYPES = ("scanned", "image_heavy", "table_heavy", "mixed", "text_rich")
ROUNDS = dict(huge=1, large=2, medium=3, small=4)
SAMPLE = dict(huge=0.1, large=0.3, medium=0.6, small=1.0)
FORMULAS = 3


def image_area_ratio(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ratio: the image blocks' share of the page (x0, y0, x1, y1, block_type, width, height), 1 at most."""
    area = F.when(F.col("block_type") == "image", F.greatest(F.lit(0.0), (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))).otherwise(0.0)
    page = F.max("width") * F.max("height")  # one size a page; max has no order
    return blocks.groupBy(*keys).agg(F.when(page > 0, F.least(F.lit(1.0), F.sum(area) / page)).otherwise(0.0).alias("ratio"))


def page_type(length: Column, ratio: Column, tables: Column, scanned: int = 100, share: float = 0.4) -> Column:
    return (
        F.when((length < scanned) & (ratio > share), "scanned")
        .when((ratio > 0.5) & (length < 5 * scanned), "image_heavy")
        .when(tables >= 2, "table_heavy")
        .when((ratio > 0.2) & (length >= scanned), "mixed")
        .otherwise("text_rich")
    )


def page_profile(pages: DataFrame) -> DataFrame:
    """pages (text_length, ratio, tables, ...) with page_type, needs_ocr, needs_vision, image_area_ratio."""
    kind = page_type(F.col("text_length"), F.col("ratio"), F.col("tables"))
    pages = pages.withColumn("page_type", kind)
    return pages.withColumns({"needs_ocr": F.col("page_type") == "scanned", "needs_vision": F.col("page_type").isin("image_heavy", "mixed"), "image_area_ratio": F.round("ratio", 3)})


def refine_vision(pages: DataFrame, elements: DataFrame, keys: list[str]) -> DataFrame:
    """needs_vision as whether the page has a picture element."""
    has = elements.groupBy(*keys).agg(F.bool_or(F.col("label") == "picture").alias("__has"))
    return pages.join(has, keys, "left").withColumn("needs_vision", F.coalesce("__has", F.lit(False))).drop("__has")


def detect_poster(pages: DataFrame, elements: DataFrame, doc: str, page: str) -> DataFrame:
    """doc, poster: five pages at most, one of them with over 800 characters but under 8 text elements."""
    some = elements.where(F.col("label").isin("paragraph", "list_item", "text", "section_header")).groupBy(doc, page).agg(F.count("*").alias("__n"))
    joined = pages.join(some, [doc, page], "left")
    return joined.groupBy(doc).agg(((F.count("*") <= 5) & F.bool_or((F.length("text") > 800) & (F.coalesce("__n", F.lit(0)) < 8))).alias("poster"))


def detect_exam(pages: DataFrame, doc: str, page: str) -> DataFrame:
    """doc, exam: an exam's marks on one of the first five pages. Marks are looked for before the pages move, so no text does."""
    marked = pages.select(doc, page, F.coalesce(F.col("text").rlike(EXAM), F.lit(False)).alias("__mark"))
    first = F.row_number().over(Window.partitionBy(doc).orderBy(page)) <= 5
    return marked.withColumn("__first", first).groupBy(doc).agg(F.bool_or(F.col("__first") & F.col("__mark")).alias("exam"))


def size_tier(n: Column) -> Column:
    return F.when(n < 50, "small").when(n < 200, "medium").when(n < 500, "large").otherwise("huge")


def vision_band(share: Column) -> Column:
    return F.when(share < 0.05, "none").when(share < 0.20, "low").when(share < 0.50, "medium").otherwise("high")


def doc_profile(pages: DataFrame, doc: str, elements: DataFrame | None = None, page: str = "page_num") -> DataFrame:
    """One row a document of pages with page_type: counts and shares by type, vision dependency, complexity, size."""
    share = {t: F.round(F.count_if(F.col("page_type") == t) / F.count("*"), 3).alias(f"share_{t}") for t in PAGE_TYPES}
    out = pages.groupBy(doc).agg(F.count("*").alias("page_count"), *share.values())
    if elements is None:
        out = out.withColumns({"vision_share": F.col("share_image_heavy") + F.col("share_mixed") + F.col("share_scanned"), "formula_count": F.lit(0).cast("long")})
    else:
        pictures = F.countDistinct(F.when(F.col("label") == "picture", F.col(page))).alias("__pictures")
        found = elements.groupBy(doc).agg(pictures, F.count_if(F.col("label") == "formula").alias("formula_count"))
        out = out.join(found, doc, "left").withColumns({"vision_share": F.coalesce("__pictures", F.lit(0)) / F.col("page_count"), "formula_count": F.coalesce("formula_count", F.lit(0))}).drop("__pictures")
    c = lambda t: F.col(f"share_{t}")
    weights = 0.30 * c("table_heavy") + 0.25 * c("image_heavy") + 0.20 * c("mixed") + 0.15 * c("scanned") + 0.10 * F.least(F.lit(1.0), F.col("page_count") / 500)
    return out.withColumns({"vision_dependency": vision_band(F.col("vision_share")), "complexity": F.round(weights, 3), "size_tier": size_tier(F.col("page_count"))})


def empty_profile(spark) -> DataFrame:
    """The profile of a document without pages."""
    row = ", ".join(f"0.0D share_{t}" for t in PAGE_TYPES)
    return spark.sql(f"SELECT 0L page_count, {row}, 0.0D vision_share, 0L formula_count, 'none' vision_dependency, 0.0D complexity, 'small' size_tier")


def parse_plan(profiles: DataFrame, primary: Column, exam: Column, poster: Column, layout: Column, math_ocr: Column) -> DataFrame:
    """profiles with model_tier, max_rounds, judge_sample_rate and the modes. The Columns say what is available or was detected."""
    pick = lambda m: F.element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), F.col("size_tier"))
    step = F.when(F.col("complexity") > 0.6, 1).when(F.col("complexity") < 0.3, -1).otherwise(0)
    base = F.when(F.col("vision_dependency") == "none", "none").when(F.col("vision_dependency") == "low", "fallback").otherwise(F.when(primary, "primary").otherwise("fallback"))
    raised = F.when((exam | poster) & (base == "none"), "fallback").otherwise(base)
    tier = F.when(poster & (raised == "fallback") & primary, "primary").otherwise(raised)
    math = (F.col("formula_count") >= FORMULAS) & math_ocr
    slides = (F.col("share_image_heavy") + F.col("share_mixed") >= 0.70) & (F.col("page_count") >= 5) & F.col("size_tier").isin("small", "medium")
    return profiles.withColumns({
        "model_tier": tier, "max_rounds": F.greatest(F.lit(1), pick(ROUNDS) + step), "judge_sample_rate": pick(SAMPLE), "use_layout": layout, "use_math_ocr": math,
        "math_engine": F.when(math, "pix2tex").otherwise("none"), "slide_mode": slides, "exam_mode": exam, "poster_mode": poster,
    })


ROUTES = ("poster", "exam", "slide", "layout", "scanned", "image_heavy", "mixed", "table_heavy", "text_rich", "fallback")


def route(kind: Column, vision: Column, poster: Column, exam: Column, slide: Column, layout: Column) -> Column:
    """The strategy of a page, by priority. Columns: page type (null: text_rich), whether vision answers, the modes, whether a layout is there."""
    kind = F.coalesce(kind, F.lit("text_rich"))
    return (
        F.when(poster & vision, "poster")
        .when(exam & kind.isin("text_rich", "mixed"), "exam")
        .when(slide & vision & kind.isin("image_heavy", "mixed"), "slide")
        .when(layout & (kind != "scanned"), "layout")
        .when(kind == "scanned", "scanned")
        .when((kind == "table_heavy"), "table_heavy")
        .when(vision & kind.isin("image_heavy", "mixed", "text_rich"), kind)
        .otherwise("fallback")
    )
