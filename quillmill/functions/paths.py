"""Paths of outputs, and sizes and times for people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stem(path: Column) -> Column:
    """The file name without its last suffix."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"(.)\.[^.]*$", "$1")


def output_paths(path: Column, root: Column) -> Column:
    """struct of the markdown path of a document and of what lies beside it; .../raw/<field>/x.pdf goes under <field>."""
    field = F.regexp_extract(path, r"(?:^|/)raw/([^/]+)/", 1)
    base = F.concat(root, F.when(field != "", F.concat(F.lit("/"), field)).otherwise(""), F.lit("/"), stem(path))
    out = {"out": ".md", "confidence": "_confidence.md", "review": "_review.md", "flagged": "_flagged.md", "images": "_images"}
    return F.struct(*[F.concat(base, F.lit(tail)).alias(name) for name, tail in out.items()])


def region_name(page: Column, label: Column, index: Column) -> Column:
    return F.format_string("p%d_%s_%d.png", page + 1, label, index)


def format_size(n: Column) -> Column:
    whole = lambda k: F.floor(n / k).cast("string")
    return F.when(n >= 1048576, F.concat(whole(1048576), F.lit(" MB"))).otherwise(F.concat(whole(1024), F.lit(" KB")))


def format_elapsed(seconds: Column) -> Column:
    s = F.floor(seconds)
    return F.when(seconds < 60, F.format_string("%.0fs", seconds)).otherwise(F.format_string("%dm %02ds", F.floor(s / 60), s % 60))


def image_name(condition: Column, index: Column, ext: Column) -> Column:
    """File name of a saved image."""
    return F.concat(F.replace(F.lower(condition), F.lit(" "), F.lit("_")), F.lit("_"), index.cast("string"), F.lit("."), ext)
