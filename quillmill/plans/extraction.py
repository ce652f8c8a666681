"""Plans of whole phases: extraction by route, engine cascades, and the scoring loop."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.models.stubs import TEXT, run_model
from quillmill.operators import judge as J
from quillmill.operators import render as R

Step = Callable[[list], list]


def with_answer(route: str, said: Column, text: Column, tables: Column) -> Column:
    """A page of this route with its step's answer: mixed has it after its own text; image_heavy and text_rich append their tables."""
    if route == "mixed":
        return F.concat_ws("\n\n", F.nullif(R.page_text(text, tables), F.lit("")), said)
    if route == "text_rich":
        return R.page_text(said, tables)
    if route == "image_heavy":
        return F.concat_ws("\n\n", said, F.filter(tables, lambda t: T.strip(t) != ""))
    return said


def extract(pages: DataFrame, steps: dict[str, Step], elements: DataFrame | None = None, keys: list[str] | None = None, vision: Column | None = None) -> DataFrame:
    """pages (route, text, tables_md, ...) with md, each route's rows through its own step.

    A Python step would be run for every row under a when(), so routes are branches of a union,
    filtered first; a step that fails or answers with remarks about the task leaves the page's own text.
    elements are the layout of pages by keys: a page of the layout route is its elements' markdown, its own
    text where that is empty, and goes through image_heavy's step where it is garbled and vision (null: any
    page) answers. Without elements it is its own text.
    """
    text, tables = F.col("text"), F.col("tables_md")
    own = R.page_text(text, tables)

    def answered(rows: DataFrame, route: str) -> DataFrame:
        done = run_model(rows, "text", steps[route], TEXT, "__r")
        said = T.unwrap_fences(F.col("__r.value"))
        if route in ("exam", "scanned"):  # what is read off a page is taken as it is, but for fences
            said = F.when(F.contains("__r.value", F.lit("```markdown")), said).otherwise(F.col("__r.value"))
        said = T.strip_hallucination(said)
        return done.withColumn("md", F.when(F.col("__r.ok") & (T.strip(said) != ""), with_answer(route, said, text, tables)).otherwise(own)).drop("__r")

    named = ["table_heavy", *steps]
    branches = [answered(pages.where(F.col("route") == route), route) for route in steps if elements is None or route != "layout"]
    if elements is not None:
        named.append("layout")
        layout = R.elements_to_markdown(elements, keys).withColumnRenamed("md", "__md")
        laid = pages.where(F.col("route") == "layout").join(layout, keys, "left")
        garbled = F.coalesce(T.is_garbled(F.col("__md")), F.lit(False))
        if "image_heavy" in steps:
            seen = garbled if vision is None else garbled & F.coalesce(vision, F.lit(False))
            branches.append(answered(laid.where(seen).drop("__md"), "image_heavy"))
            laid = laid.where(~seen)
        branches.append(laid.withColumn("md", F.when(T.strip(F.col("__md")) != "", F.col("__md")).otherwise(own)).drop("__md"))
    table = pages.where(F.col("route") == "table_heavy").withColumn("md", R.table_page(text, tables))
    rest = pages.where(~F.col("route").isin(*named) | F.col("route").isNull()).withColumn("md", own)
    return reduce(DataFrame.unionByName, [*branches, table, rest])


def cascade(df: DataFrame, col: str, engines: list[Step], name: str) -> DataFrame:
    """df with name, the first engine's answer, and engine, its number; an engine sees only rows that those before failed; null if all do."""
    open_, done = df, []
    for i, engine in enumerate(engines):
        tried = run_model(open_, col, engine, TEXT, "__r")
        done.append(tried.where("__r.ok").withColumns({name: F.col("__r.value"), "engine": F.lit(i)}).drop("__r"))
        open_ = tried.where("not __r.ok").drop("__r")
    last = open_.withColumns({name: F.lit(None).cast("string"), "engine": F.lit(None).cast("int")})
    return reduce(DataFrame.unionByName, [*done, last])


def format_documents(docs: DataFrame, col: str, step: Step, chars: int = 3 * 32_768, seconds: float | None = None) -> DataFrame:
    """docs with col cleaned by a formatting model where it needs it.

    The model sees the first chars characters; what is beyond is put behind its answer. A text that needs no
    formatting isn't sent. A failed, empty or late answer, and one that loses too much, leaves the text as it was.
    """
    text, sent = F.col(col), F.left(F.col(col), F.lit(chars))
    needs = F.coalesce(T.needs_format(text), F.lit(False))
    asked = run_model(docs.where(needs).withColumn("__in", sent), "__in", step, TEXT, "__r", seconds)
    said = F.when(F.col("__r.ok"), F.nullif(T.strip_think_reply(F.col("__r.value")), F.lit("")))
    whole = F.concat(said, F.when(F.length(text) > chars, F.concat(F.lit("\n\n"), F.substring(text, chars + 1, 1 << 30))).otherwise(""))
    good = said.isNotNull() & T.content_loss_ok(F.col("__in"), said)
    done = asked.withColumn(col, F.when(good, whole).otherwise(text)).select(*docs.columns)
    return docs.where(~needs).unionByName(done)


def split_by_judge(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages for a vision judge, and those that word recall can judge."""
    vision = F.col("page_type").isin("image_heavy", "mixed", "scanned")
    return pages.where(vision), pages.where(~vision)


def union_scores(new: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    """New scores, and carried ones of pages not judged again."""
    return new.unionByName(carried.join(new.select(*keys), keys, "left_anti").select(*new.columns))


#: What the patching stand-in puts before the missing words.
RECOVERED = "\n\n## Recovered\n\n"


def patch(text: Column, md: Column) -> Column:
    """A deterministic stand-in for the patching agent: the source's missing words under a heading, kept if no content is lost."""
    return patched(md, F.array_except(T.word_set(text), T.word_set(md)))


def patched(md: Column, missing: Column) -> Column:
    new = F.when(F.size(missing) > 0, F.concat(md, F.lit(RECOVERED), F.array_join(F.array_sort(missing), " "))).otherwise(md)
    return F.when(T.content_loss_ok(md, new), new).otherwise(md)


def quality_loop(drafts: DataFrame, key: str, max_rounds: int = 3) -> DataFrame:
    """key, round_num, score, action of the best round of each draft (key, text, md).

    Rounds are a constant few, so they are columns of one pass: no action, no join and no
    collecting between them. A draft that is accepted isn't patched again. Sets of words are
    columns too: the source's is made once, a draft's when it changes.
    """
    rows = drafts.select(key, "text", "md", F.lit(True).alias("__open"), F.lit(None).cast("struct<score:double,last:int,action:string>").alias("__best"))
    rows = rows.withColumns({"__source": T.word_set(F.col("text")), "__shown": T.word_set(F.col("md"))})
    for n in range(1, max_rounds + 1):
        rows = J.heuristic(rows, rounded=F.round, words=("__source", "__shown")).select(key, "text", "md", "__open", "__best", "__source", "__shown", "score", "action")
        this = F.when(F.col("__open"), F.struct("score", F.lit(-n).alias("last"), "action"))
        rows = rows.withColumns({"__best": F.greatest("__best", this), "__open": F.col("__open") & (F.col("action") != "accept")})
        if n < max_rounds:
            rows = rows.withColumn("__missing", F.when(F.col("__open"), F.array_except("__source", "__shown")))
            rows = rows.withColumn("md", F.when(F.col("__open"), patched(F.col("md"), F.col("__missing"))).otherwise(F.col("md")))
            rows = rows.withColumn("__shown", F.when(F.size("__missing") > 0, T.word_set(F.col("md"))).otherwise(F.col("__shown"))).drop("__missing")
    return rows.select(key, (-F.col("__best.last")).alias("round_num"), "__best.score", "__best.action")
