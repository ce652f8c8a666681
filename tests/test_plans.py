"""Plans keep the shape they are meant to have: shuffles, pruning, pushed filters, no row-wise Python."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from quillmill.operators import lines as L
from quillmill.operators import registry as Y
from quillmill.queries import QUERIES
from quillmill.queries.base import table


def plan(df) -> str:
    # Before run-time changes: what was asked for.
    return df._jdf.queryExecution().sparkPlan().toString() + "\n" + df._jdf.queryExecution().executedPlan().toString()


def shuffles(df) -> int:
    return len(re.findall(r"\bExchange (?:hash|range|Single|Round)", df._jdf.queryExecution().executedPlan().toString()))


@pytest.mark.parametrize("name", ["dedup_lines", "strip_exam_headers", "page_classify", "structure_score", "word_set", "clean_ocr", "heading_outline", "route_pages"])
def test_rows_stay_where_they_are(spark, sf, name):
    at_most = 1 if name in ("page_classify", "route_pages") else 0  # those number a document's pages
    assert shuffles(QUERIES[name](spark, sf)) <= at_most


@pytest.mark.parametrize("name", ["dedup_sections", "validate_tables", "postprocess_run", "reference_skip"])
def test_line_windows_shuffle_once(spark, sf, name):
    assert shuffles(QUERIES[name](spark, sf)) == 1


def test_scans_read_only_what_is_used(spark, sf):
    got = plan(QUERIES["page_profile"](spark, sf))
    assert re.search(r"ReadSchema: struct<doc_id:bigint,text:string,source:string>", got)
    got = plan(L.dedup_lines(table(spark, sf, "documents").select("doc_id", "text"), "text").where("doc_id < 5"))
    assert "LessThan(doc_id,5)" in got and "lang" not in got


def test_filters_reach_the_registry_scan(spark, sf, tmp_path):
    path = str(tmp_path / "reg")
    table(spark, sf, "events").select(F.lit("p").alias("pdf"), F.col("event_type").alias("status"), F.lit(0).alias("flagged_pages")).write.parquet(path)
    assert re.search(r"PushedFilters: .*In\(status", plan(Y.by_status(spark.read.parquet(path), Y.PENDING, Y.ERROR)))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"judge_l4_stub", "ocr_cascade", "scan_pages", "scan_tables", "route_dispatch", "format_documents", "describe_regions", "describe_images", "math_ocr"}))
def test_no_python_but_in_model_steps(spark, sf, name):
    assert not re.search(r"BatchEvalPython|ArrowEvalPython|MapIn(?:Arrow|Pandas)|FlatMapGroups", plan(QUERIES[name](spark, sf)))


def test_quality_loop_makes_the_source_words_once(spark):
    from quillmill.plans import extraction as X

    drafts = spark.createDataFrame([(1, "some words here", "some")], "k int, text string, md string")
    plan = X.quality_loop(drafts, "k")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(lower(text") == 1


def test_split_sections_stays_in_the_row(spark):
    from quillmill.operators import lines as L

    docs = spark.createDataFrame([(1, "DIAGNOSIS AND TESTS\na")], "k int, t string")
    plan = L.split_sections(docs, "t", ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_the_cleaning_chain_strips_comments_once(spark, sf):
    plan = QUERIES["postprocess_run"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?i)<!--(") == 1
