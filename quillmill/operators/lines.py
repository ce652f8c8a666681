"""Operators on the lines of a text.

What a line's neighbours decide is an array expression over the split text: no rows, no shuffle.
What needs order among groups of lines is a window over exploded blocks or lines; all of those
partition by the same keys, so a chain of them shuffles once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions import text as T

_LINES = "__lines"


def split_lines(c: Column) -> Column:
    return F.split(c, r"\n", -1)


def _by_array(df: DataFrame, col: str, keep) -> DataFrame:
    """df with col's lines filtered by keep(lines, stripped lines, line, index); lines are materialised once."""
    df = df.withColumn(_LINES, split_lines(F.col(col)))
    lines = F.col(_LINES)
    return df.withColumn(col, F.array_join(F.filter(lines, lambda x, i: keep(lines, x, i)), "\n")).drop(_LINES)


def dedup_lines(df: DataFrame, col: str) -> DataFrame:
    """Without lines equal to the line before, blank ones aside."""
    return _by_array(df, col, lambda lines, x, i: (T.trim_line(x) == "") | (i == 0) | (x != F.get(lines, i - 1)))


def strip_exam_headers(df: DataFrame, col: str) -> DataFrame:
    """Without page number lines, and without header lines but for the first of each wording.

    Headers are sorted by wording to find the first of each, and merged with the other lines by place: no line is looked up among all.
    """
    numbered = F.transform(split_lines(F.col(col)), lambda x, i: F.struct(i.alias("i"), x.alias("x"), T.trim_line(x).alias("s")))
    kind = F.transform(numbered, lambda e: F.struct(e["i"].alias("i"), e["x"].alias("x"), e["s"].alias("s"), F.when(e["s"].rlike(T.PAGE_LINE), 2).when(e["s"].rlike(T.HEADER_LINE), 1).otherwise(0).alias("k")))
    df = df.withColumn(_LINES, kind)
    heads = F.array_sort(F.transform(F.filter(_LINES, lambda e: e["k"] == 1), lambda e: F.struct(e["s"].alias("s"), e["i"].alias("i"), e["x"].alias("x"))))
    df = df.withColumn("__heads", heads)
    first = F.filter("__heads", lambda e, i: (i == 0) | (e["s"] != F.get("__heads", i - 1)["s"]))
    place = lambda a: F.transform(a, lambda e: F.struct(e["i"].alias("i"), e["x"].alias("x")))
    other = place(F.filter(_LINES, lambda e: e["k"] == 0))
    kept = F.when(F.size("__heads") > 0, F.array_sort(F.concat(other, place(first)))).otherwise(other)
    return df.withColumn(col, F.array_join(F.transform(kept, lambda e: e["x"]), "\n")).drop(_LINES, "__heads")


def _join(rows: DataFrame, keys: list[str], rest: list[str], col: str, order: str, line: str) -> DataFrame:
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line))), lambda x: x[line]), "\n")
    return rows.groupBy(*keys).agg(*[F.first(c).alias(c) for c in rest], joined.alias(col))


def dedup_sections(df: DataFrame, col: str, keys: list[str]) -> DataFrame:
    """One section of each heading: the longest, earliest among equals, at the place of the first. keys identify rows."""
    rest = [c for c in df.columns if c != col and c not in keys]
    # By keys alone: that serves the window by heading and the joining below.
    rows = df.repartition(*keys).select(*keys, *rest, F.posexplode(F.split(col, r"\n(?=#{1,4}[^\S\n]+\S)", -1)).alias("block", "body"))
    headed = F.col("body").rlike(r"^#{1,4}[^\S\n]+\S")
    lines = F.slice(split_lines(F.col("body")), 2, 1 << 30)
    size = F.aggregate(lines, F.lit(0), lambda n, x: n + F.length(T.trim_line(x)))
    rows = rows.withColumn("head", F.when(headed, F.lower(T.strip(F.substring_index("body", "\n", 1)))))
    rows = rows.withColumn("head", F.coalesce("head", F.concat(F.lit("\x00"), F.col("block").cast("string"))))
    rows = rows.withColumn("size", size)
    w = Window.partitionBy(*keys, "head")
    rows = rows.withColumns({"place": F.min("block").over(w), "nth": F.row_number().over(w.orderBy(F.desc("size"), "block"))}).where("nth = 1")
    return _join(rows, keys, rest, col, "place", "body").select(*df.columns)


def validate_tables(df: DataFrame, col: str, keys: list[str]) -> DataFrame:
    """Table rows whose number of columns isn't that of the separator get a comment saying so.

    A run of table rows counts as a table from its first row with a separator among the next three lines.
    """
    rest = [c for c in df.columns if c != col and c not in keys]
    rows = df.select(*keys, *rest, F.posexplode(split_lines(F.col(col))).alias("pos", "line"))
    s = T.trim_line(F.col("line"))
    # Lines of prose end at the first test, before any pattern.
    bar = s.startswith("|")
    rows = rows.withColumns({"row": bar & s.rlike(r"^\|.+\|$"), "sep": bar & s.rlike(r"^[|][-\s:|]+[|]$"), "cols": F.length("line") - F.length(F.replace("line", F.lit("|"), F.lit(""))) - 1})
    w = Window.partitionBy(*keys).orderBy("pos")
    ahead = F.first(F.when(F.col("sep"), F.col("cols")), ignorenulls=True).over(w.rowsBetween(1, 3))
    rows = rows.withColumns({"ahead": ahead, "run": F.sum((~F.col("row")).cast("int")).over(w)})
    starts = F.when(F.col("row") & F.col("ahead").isNotNull(), F.struct("pos", "ahead"))
    rows = rows.withColumn("start", F.min(starts).over(Window.partitionBy(*keys, "run")))
    bad = F.col("row") & (F.col("pos") >= F.col("start.pos")) & ~F.col("sep") & (F.col("cols") != F.col("start.ahead"))
    note = F.format_string("  <!-- col mismatch: expected %d got %d -->", "start.ahead", "cols")
    rows = rows.withColumn("line", F.when(bad, F.concat("line", note)).otherwise(F.col("line")))
    return _join(rows, keys, rest, col, "pos", "line").select(*df.columns)


def postprocess(df: DataFrame, col: str, keys: list[str]) -> DataFrame:
    """The full cleaning chain, in its fixed order; one shuffle, by keys."""
    for step in (T.strip_html_comments, T.clean_latex_blocks, T.clean_latex_inline):
        df = df.withColumn(col, step(F.col(col)))
    df = strip_exam_headers(df, col).withColumn(col, T.strip_think(F.col(col)))
    df = validate_tables(dedup_lines(dedup_sections(df, col, keys), col), col, keys)
    return df.withColumn(col, T.normalize_ws(F.col(col)))


def skip_references(df: DataFrame, col: str, keys: list[str]) -> DataFrame:
    """Without slogans, and without the citations that follow a line REFERENCES, up to the first other line."""
    rest = [c for c in df.columns if c != col and c not in keys]
    rows = df.select(*keys, *rest, F.posexplode(split_lines(F.col(col))).alias("pos", "line")).withColumn("s", T.strip(F.col("line")))
    slogan, mark = F.col("s").isin(*T.SLOGANS), F.col("s") == "REFERENCES"
    cited = (F.col("s") == "") | F.col("s").rlike(r"^(?:\d+\.\s+|https?://)")
    w = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda c: F.coalesce(F.max(F.when(c, F.col("pos"))).over(w), F.lit(-1))
    rows = rows.withColumns({"mark": last(mark), "other": last(~slogan & ~mark & ~cited)})
    drop = slogan | mark | (cited & (F.col("mark") > F.col("other")))
    # A text of dropped lines alone stays as an empty one.
    rows = rows.withColumn("line", F.when(~drop, F.col("line")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("pos", "line")))), lambda x: x["line"]), "\n")
    return rows.groupBy(*keys).agg(*[F.first(c).alias(c) for c in rest], T.strip(joined).alias(col)).select(*df.columns)


def split_sections(df: DataFrame, col: str, keys: list[str]) -> DataFrame:
    """keys, ord, name, body: the sections under capital headers, abbreviations gathered last.

    A later section of the same name replaces the body but keeps the first one's place. A row's sections are made
    within the row: no shuffle. Blocks are sorted by name to find the first and last of each.
    """
    stripped = F.filter(F.transform(split_lines(F.col(col)), T.strip), lambda s: s != "")
    known = F.transform(stripped, lambda s: F.struct(s.alias("s"), T.header_body(s).alias("b"), (s.rlike(T.ABBREVIATION) & (F.length(s) < 55)).alias("short")))
    known = F.transform(known, lambda e: F.struct(e["s"].alias("s"), e["b"].alias("b"), e["short"].alias("short"), (~e["short"] & T.header_like(e["s"], e["b"])).alias("head")))
    rows = df.select(*keys, known.alias(_LINES))
    rows = rows.withColumn("__heads", F.filter(F.transform(_LINES, lambda e, i: F.when(e["head"], i + 1)), lambda i: i.isNotNull()))
    rows = rows.withColumns({"__from": F.concat(F.array(F.lit(0)), "__heads"), "__to": F.concat("__heads", F.array(F.size(_LINES) + 1))})
    name = lambda p: F.when(p > 0, T.strip(F.get(_LINES, p - 1)["b"])).otherwise("OVERVIEW")
    held = lambda p, b: F.filter(F.slice(_LINES, p + 1, F.get("__to", b) - p - 1), lambda e: ~e["short"])
    blocks = F.transform("__from", lambda p, b: F.struct(name(p).alias("name"), b.alias("block"), F.transform(held(p, b), lambda e: e["s"]).alias("held")))
    blocks = F.transform(F.filter(blocks, lambda x: F.size(x["held"]) > 0), lambda x: F.struct(x["name"].alias("name"), x["block"].alias("block"), F.array_join(x["held"], "\n").alias("body")))
    rows = rows.withColumn("__blocks", F.array_sort(blocks))
    first = F.filter("__blocks", lambda x, i: (i == 0) | (x["name"] != F.get("__blocks", i - 1)["name"]))
    last = F.filter("__blocks", lambda x, i: (i == F.size("__blocks") - 1) | (x["name"] != F.get("__blocks", i + 1)["name"]))
    named = F.zip_with(first, last, lambda f, x: F.struct(f["block"].alias("place"), f["name"].alias("name"), x["body"].alias("body"), T.abbreviations_only(x["body"]).alias("only")))
    rows = rows.withColumn("__named", F.array_sort(named))
    moved = F.flatten(F.transform(F.filter("__named", lambda x: x["only"]), lambda x: split_lines(x["body"])))
    rows = rows.withColumn("__short", F.concat(F.transform(F.filter(_LINES, lambda e: e["short"]), lambda e: e["s"]), moved))
    part = lambda n, b: F.struct(n.alias("name"), b.alias("body"))
    plain = F.transform(F.filter("__named", lambda x: ~x["only"]), lambda x: part(x["name"], x["body"]))
    gathered = F.array(part(F.lit("ABBREVIATIONS"), F.array_join("__short", "\n")))
    rows = rows.select(*keys, F.posexplode(F.when(F.size("__short") > 0, F.concat(plain, gathered)).otherwise(plain)).alias("ord", "__part"))
    return rows.select(*keys, "ord", "__part.name", "__part.body")


def heading_outline(c: Column, limit: int = 40) -> Column:
    """The first headings of level two and deeper, without their marks."""
    heads = F.filter(split_lines(c), lambda x: x.startswith("##"))
    return F.slice(F.transform(heads, lambda x: T.strip(F.regexp_replace(x, r"^#+", ""))), 1, limit)
