"""Model-backed steps over regions, formulas and images. A step gets (kind, content) as one string, see prompt()."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.models.stubs import TEXT, run_model

Step = Callable[[list], list]
#: Kinds of region that have a prompt of their own; the rest share the figure's.
KINDS = ("ecg", "diagram", "figure")


def prompt(kind: Column, content: Column) -> Column:
    """What a step gets: the kind it is asked about, a line end, and the content (or its reference)."""
    return F.concat(F.when(kind.isin(*KINDS), kind).otherwise("figure"), F.lit("\n"), F.coalesce(content, F.lit("")))


def describe_regions(regions: DataFrame, step: Step, seconds: float | None = None) -> DataFrame:
    """regions (label, content, ...) with description: the reply without fences, empty if it talks about the task, null if the call failed."""
    asked = run_model(regions.withColumn("__p", prompt(F.col("label"), F.col("content"))), "__p", step, TEXT, "__r", seconds)
    said = T.strip_hallucination(T.unwrap_fences(F.col("__r.value")))
    return asked.withColumn("description", F.when(F.col("__r.ok"), said)).drop("__p", "__r")


def math_engine(wanted: Column, cloud: Column, local: Column) -> Column:
    """The engine in use: mathpix, pix2tex or none, by the one asked for and whether each is there."""
    here = F.when(local, "pix2tex").otherwise("none")
    return F.when(wanted == "mathpix", F.when(cloud, "mathpix").otherwise("pix2tex")).when(wanted == "auto", F.when(cloud, F.lit("mathpix")).otherwise(here)).when(wanted == "pix2tex", here).otherwise("none")


def read_equations(elements: DataFrame, steps: dict[str, Step], seconds: float | None = None) -> DataFrame:
    """elements (label, text, engine, ...) with equation, LaTeX of each formula, null where no engine reads it.

    mathpix falls back on pix2tex where its answer is empty; rows that aren't formulas go to no engine.
    """
    formula = F.coalesce((F.col("label") == "formula") & F.col("engine").isin(*steps), F.lit(False))
    rest = elements.where(~formula).withColumn("equation", F.lit(None).cast("string"))
    done = []
    open_ = elements.where(formula)
    answer = F.when(F.col("__r.ok"), F.nullif(T.strip(F.col("__r.value")), F.lit("")))
    if "mathpix" in steps:
        tried = run_model(open_.where("engine = 'mathpix'"), "text", steps["mathpix"], TEXT, "__r", seconds).withColumn("equation", answer).drop("__r")
        open_ = open_.where("engine <> 'mathpix'")
        if "pix2tex" in steps:
            done.append(tried.where("equation IS NOT NULL"))
            open_ = open_.unionByName(tried.where("equation IS NULL").drop("equation"))
        else:
            done.append(tried)
    if "pix2tex" in steps:
        done.append(run_model(open_, "text", steps["pix2tex"], TEXT, "__r", seconds).withColumn("equation", answer).drop("__r"))
    return reduce(DataFrame.unionByName, [rest, *done])


def describe_images(images: DataFrame, steps: list[Step], least: int = 50, seconds: float | None = None) -> DataFrame:
    """images (image_index, kind, condition, specialty, ...) with description: the first engine's answer of over least characters, else a note that all failed."""
    about = F.format_string("Condition: %s (%s)", F.coalesce("condition", F.lit("")), F.coalesce("specialty", F.lit("")))
    open_, done = images.withColumn("__p", prompt(F.col("kind"), about)), []
    for step in steps:
        tried = run_model(open_, "__p", step, TEXT, "__r", seconds)
        good = F.coalesce(F.col("__r.ok") & (F.length("__r.value") > least), F.lit(False))
        done.append(tried.where(good).withColumn("description", F.col("__r.value")).drop("__r", "__p"))
        open_ = tried.where(~good).drop("__r")
    note = F.format_string("[Image %d: All vision models failed — ECG/diagram description unavailable]", F.col("image_index") + 1)
    return reduce(DataFrame.unionByName, [*done, open_.withColumn("description", note).drop("__p")])
