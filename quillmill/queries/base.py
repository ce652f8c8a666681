"""Registration of queries, and the relations they run on, for Spark and as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_NL = "chr(10)"
#: Documents dressed up as extracted markdown, the same string in both dialects; {S} is the string type.
_MARKDOWN = (
    "'<!-- page '||cast(doc_id as {S})||' -->'||NL||'## '||upper(source)||NL||text||NL||'<!-- TABLES: x'||NL||'y -->'||NL||'GATE 2024'||NL||'Page 1 of 2'||NL||'GATE 2024'||NL"
    "||'| a | b |'||NL||'|---|---|'||NL||'| '||lang||' |'||NL||NL||NL||NL||'## '||upper(source)||NL||'tail  '||NL||'<think>z</think>'||NL||'see /think more'||NL"
    "||'cost $x'||lang||'é_1$ or $$'||NL||'yñ'||NL||'$$ end'||NL||'page 3 of 9 and page 4 of 9'||NL||'#### Sub'||NL||'```'||NL||'code'||NL||'```'||NL||'same'||NL||'same'"
).replace("NL", _NL)


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, text, m."""
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text", F.expr(_MARKDOWN.format(S="string")).alias("m"))


MD = f"md AS (SELECT doc_id, source, lang, text, {_MARKDOWN.format(S='varchar')} AS m FROM documents)"
#: Strip as the engine strips.
def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page profiles' input: source is the document, pages in the order of doc_id; image share and tables are made up from doc_id."""
    docs = table(spark, sf_dir, "documents")
    from pyspark.sql import Window

    n = (F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1).alias("page_num")
    return docs.select("source", "doc_id", n, "text", F.length("text").alias("text_length"), ((F.col("doc_id") % 11) / 10.0).alias("ratio"), (F.col("doc_id") % 4).alias("tables"))


PAGES = "pg AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS page_num, text, length(text) AS text_length, (doc_id % 11) / 10.0::DOUBLE AS ratio, doc_id % 4 AS tables FROM documents)"
TYPE_SQL = "CASE WHEN text_length < 100 AND ratio > 0.4 THEN 'scanned' WHEN ratio > 0.5 AND text_length < 500 THEN 'image_heavy' WHEN tables >= 2 THEN 'table_heavy' WHEN ratio > 0.2 AND text_length >= 100 THEN 'mixed' ELSE 'text_rich' END"
