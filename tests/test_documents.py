"""Rendering, layout, registry, plans, models, files and streams."""

import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from quillmill.functions import paths as H
from quillmill.models import stubs as M
from quillmill.operators import history as C
from quillmill.operators import judge as J
from quillmill.operators import layout as G
from quillmill.operators import profile as P
from quillmill.operators import registry as Y
from quillmill.operators import render as R
from quillmill.plans import catalog as K
from quillmill.plans import extraction as X
from quillmill.sinks import files as S
from quillmill.sources import files as Z
from quillmill.streaming import discovery as D

T0 = dt.datetime(2024, 1, 1)


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_tables(spark):
    rows = spark.createDataFrame([(0, [["a\nb", None], [" c ", "d|e"]]), (1, []), (2, [["x"]])], "i int, rows array<array<string>>")
    got = [r.x for r in rows.select("i", R.table_to_markdown(F.col("rows")).alias("x")).orderBy("i").collect()]
    assert got == ["| a b |  |\n| --- | --- |\n| c | d|e |", "", "| x |\n| --- |"]
    rows = spark.createDataFrame([(0, [["long enough", "cells to pass"], ["x", None]]), (1, [["two", "cells only, however long they are"]]), (2, [["a", "b", "c"]])], "i int, rows array<array<string>>")
    assert [r.x for r in rows.select("i", R.useful_table(F.col("rows")).alias("x")).orderBy("i").collect()] == [True, False, False]


def test_elements(spark):
    rows = [(0, 0, "title", 0, "T", "", None), (0, 1, "section_header", 2, "S", "", None), (0, 2, "footnote", 0, "note", "", None), (0, 3, "picture", 0, "", "", "seen"), (0, 4, "picture", 0, "", "", None), (0, 5, "table", 0, "", " |a| ", None), (0, 6, "formula", 0, "x^2", "", None), (0, 7, "text", 0, " ", "", None), (0, 8, "text", 0, "end", "", None)]
    el = spark.createDataFrame(rows, "k int, ord int, label string, level int, text string, table_md string, description string")
    got = R.elements_to_markdown(el, ["k"]).first().md
    assert got == "# T\n\n### S\n\nseen\n\n<!-- figure: figure 1 (vision unavailable) -->\n\n|a|\n\n`x^2`\n\nend\n\n---\n**Footnotes**\n\n- note"


def test_reports(spark):
    scores = spark.createDataFrame([("d", 1, 4.5, "Low", ["g1", "g2", "g3"], "text"), ("d", 0, 9.0, "High", ["h"], "")], "doc string, page_num int, score double, confidence string, gaps array<string>, text string")
    metrics = spark.createDataFrame([("d", 6.8, 0.5, 0.999, 2, 1, True), ("e", 0.0, 0.0, 1.0, 0, 0, False)], "doc string, judge_score double, coverage_rate double, completeness double, heading_count int, table_count int, judged boolean")
    got = {r.doc: r.report for r in R.confidence_report(scores, metrics, "doc").collect()}
    assert got["d"].index("| 1 | High | 9.0 | — |") < got["d"].index("| 2 | Low | 4.5 | g1; g2 |") and "99% words" in got["d"] and "(1/2)" in got["d"]
    assert "Vision judge did not run" in got["e"] and "Judge Score" not in got["e"]
    read = spark.createDataFrame([(got["d"],), (got["e"],)], "t string").select(R.report_parse(F.col("t")).alias("r")).collect()
    assert read[0].r.score == 6.8 and read[0].r.best == 6.8 and read[0].r.structure == "2 headings · 1 tables" and read[1].r.score is None
    low = R.flagged_pages(scores, scores, "doc").collect()
    assert len(low) == 1 and low[0].n_flagged == 1 and "## Page 2  ·  score 4.5/10" in low[0].report and "- g3" in low[0].report and "```\ntext\n```" in low[0].report
    assert R.review_input(scores, "doc").first().raw == "[Page 2]\ntext"


def test_names_and_formats(spark):
    assert one(spark, R.title_case(F.lit("o'neil HEART-failure 2nd"))) == "o'neil HEART-failure 2nd".title()
    assert one(spark, R.name_title(F.lit("a/b/heart_failure.v2.pdf"))) == "Heart Failure.V2" and one(spark, R.file_slug(F.lit("A b/C"))) == "a_b_c.md"
    assert [one(spark, H.format_elapsed(F.lit(float(s)))) for s in (45, 60, 125)] == ["45s", "1m 00s", "2m 05s"]
    assert [one(spark, H.format_size(F.lit(n))) for n in (1023, 1024, 1048576)] == ["0 KB", "1 KB", "1 MB"]
    p = one(spark, H.output_paths(F.lit("/d/raw/cardio/x.y.pdf"), F.lit("out")))
    assert p.out == "out/cardio/x.y.md" and p.flagged == "out/cardio/x.y_flagged.md" and one(spark, H.output_paths(F.lit("x.pdf"), F.lit("out"))).out == "out/x.md"
    assert one(spark, H.region_name(F.lit(0), F.lit("ecg"), F.lit(2))) == "p1_ecg_2.png"
    assert [one(spark, R.score_band(F.lit(s).cast("double"))) for s in (None, 9.0, 8.0, 6.0, 5.9)] == ["—", "✅", "🟡", "🟠", "🔴"]


def test_geometry(spark):
    b = spark.createDataFrame([(0, 0, 300.0, 50.0, 500.0, 60.0), (0, 1, 0.0, 40.0, 600.0, 45.0), (0, 2, 10.0, 40.0, 100.0, 60.0), (0, 3, 10.0, 10.0, 100.0, 20.0), (0, 4, 0.0, 90.0, 590.0, 99.0)], "k int, ord int, x0 double, y0 double, x1 double, y1 double")
    assert [r.ord for r in G.spatial_sort(b, ["k"], F.lit(600.0)).orderBy("reading_order").collect()] == [3, 1, 2, 4, 0]
    assert [one(spark, G.classify_region(F.lit(w), F.lit(h))) for w, h in ((760, 300), (750, 300), (201, 151), (200, 151), (900, 0))] == ["ecg", "diagram", "diagram", "figure", "diagram"[:0] or "figure"]
    assert one(spark, G.resize_dims(F.lit(2048), F.lit(1000), 1024)).asDict() == {"w": 1024, "h": 500} and one(spark, G.resize_dims(F.lit(10), F.lit(20), 1024)).asDict() == {"w": 10, "h": 20}
    box = lambda *v: one(spark, G.crop_box(*[F.lit(x) for x in v], F.lit(100), F.lit(100)))
    assert box(0.1, 0.1, 0.5, 0.5).asDict() == {"x0": 10, "y0": 10, "x1": 50, "y1": 50} and box(0.5, 0.1, 0.5, 0.5) is None and box(0.1, 0.1, 0.13, 0.5) is None
    lines = spark.createDataFrame([(0, "text", [["a", "b "], [" "], ["ﬁn"]]), (1, "image", None), (2, "text", [[" "]])], "k int, block_type string, lines array<array<string>>")
    assert [(r.k, r.text) for r in G.blocks_from_lines(lines).orderBy("k").collect()] == [(0, "ab\nfin"), (1, "")]


def test_profiles_and_plans(spark):
    assert P.empty_profile(spark).first().vision_dependency == "none"
    pages = spark.createDataFrame([("a", i, "image_heavy" if i < 8 else "text_rich") for i in range(10)] + [("b", 0, "text_rich")], "doc string, page_num int, page_type string")
    el = spark.createDataFrame([("a", 0, "picture"), ("a", 0, "picture"), ("a", 1, "formula"), ("a", 1, "formula"), ("a", 2, "formula")], "doc string, page_num int, label string")
    got = {r.doc: r for r in P.doc_profile(pages, "doc", el).collect()}
    assert got["a"].vision_share == 0.1 and got["a"].vision_dependency == "low" and got["a"].formula_count == 3 and got["b"].vision_dependency == "none"
    plan = {r.doc: r for r in P.parse_plan(P.doc_profile(pages, "doc", el), F.lit(True), F.lit(False), F.col("doc") == "b", F.lit(True), F.lit(True)).collect()}
    assert plan["a"].slide_mode and plan["a"].use_math_ocr and plan["a"].model_tier == "fallback" and plan["a"].max_rounds == 3
    assert plan["b"].model_tier == "primary" and plan["b"].poster_mode and not plan["b"].slide_mode
    bands = [one(spark, P.vision_band(F.lit(s))) for s in (0.049, 0.05, 0.2, 0.5)]
    assert bands == ["none", "low", "medium", "high"]


def _registry(spark):
    rows = [("a", T0, "done", T0, 1.0, 3, 0, None), ("b", T0, "error", None, None, None, 2, "x"), ("c", T0, "pending", T0, None, None, None, None), ("d", T0, "flagged", T0, 2.0, 1, 1, None)]
    return spark.createDataFrame(rows, Y.SCHEMA)


def test_registry(spark, tmp_path):
    reg = _registry(spark)
    assert [r.pdf for r in Y.listing(reg).collect()] == ["b", "d", "a", "c"]
    assert {r.pdf for r in Y.done(reg).collect()} == {"a", "d"} and {r.pdf for r in Y.flagged(reg).collect()} == {"b", "d"}
    new = spark.createDataFrame([("a", None), ("e", 5.0)], "pdf string, score double")
    got = {r.pdf: r for r in Y.upsert(reg, new, ["score"], F.expr("timestamp'2024-05-01 00:00:00'")).collect()}
    assert got["a"].score is None and got["a"].added == T0 and got["e"].score == 5.0 and got["e"].added == dt.datetime(2024, 5, 1) and got["d"].score == 2.0
    found = spark.createDataFrame([("a",), ("z",), ("y",)], "pdf string")
    assert [r.pdf for r in Y.discover(found, reg).collect()] == ["y", "z"]
    assert Y.mark_pending(found, reg, F.expr("timestamp'2024-05-01 00:00:00'")).where("status = 'pending'").count() == 3 and Y.remove(reg, found).count() == 3
    assert one(spark, Y.key(F.lit("/w/x/a.pdf"), F.lit("/w"))) == "x/a.pdf" and one(spark, Y.key(F.lit("/v/a.pdf"), F.lit("/w/"))) == "/v/a.pdf"
    path = str(tmp_path / "reg")
    assert Z.load_registry(spark, path).count() == 0
    S.save_registry(reg, path)
    S.save_registry(Z.load_registry(spark, path).where("pdf <> 'a'"), path)
    assert {r.pdf for r in Z.load_registry(spark, path).collect()} == {"b", "c", "d"} and sorted(os.listdir(tmp_path)) == ["reg"]


def test_scores_over_rounds(spark):
    r = spark.createDataFrame([(1, 1, 5.0), (1, 2, 7.0), (1, 3, 7.0), (2, 1, 0.0), (3, 1, 9.5), (3, 2, 3.0)], "page int, round_num int, score double")
    assert {(x.page, x.round_num) for x in J.best_round(r, ["page"]).collect()} == {(1, 2), (3, 1)}
    assert {(x.page, x.score) for x in J.carryover(r, ["page"]).collect()} == {(3, 3.0)}
    s = spark.createDataFrame([(1, 1, 9.0, "accept", ["b"]), (1, 0, 8.0, "accept", ["a"]), (2, 0, 9.0, "accept", []), (2, 1, 1.0, "fallback", [])], "d int, page_num int, score double, action string, gaps array<string>")
    got = {x.d: x for x in J.round_aggregate(s, ["d"]).collect()}
    assert got[1].gaps == ["a", "b"] and got[1].action == "accept" and got[2].action == "fallback" and got[2].score == 5.0
    pages = spark.createDataFrame([(0, i, "scanned" if i % 5 == 0 else "text_rich") for i in range(20)] + [(1, 0, "text_rich")], "d int, p int, page_type string")
    sample = J.judge_sample(pages, "d", "p", F.lit(0.3)).collect()
    assert sum(x.d == 0 for x in sample) == 6 and {x.p for x in sample if x.d == 0} > {0, 5, 10, 15} and sum(x.d == 1 for x in sample) == 1


def test_history(spark):
    rows = [(1, i, "user", "x" * 100) for i in range(8)] + [(2, i, "user", "x" * 1000) for i in range(5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert {r.conv_id: r.tokens for r in C.estimate_tokens(df).collect()} == {1: 200, 2: 1250}
    got = C.compress_history(df, 100).orderBy("conv_id", "pos").collect()
    assert [r.role for r in got if r.conv_id == 1] == ["user", "system"] + ["user"] * 4 and got[1].text == "[Prior context summary]\n3 messages, 300 characters" and sum(r.conv_id == 2 for r in got) == 5
    assert C.compress_history(df, 200).count() == 13


def test_catalogue(spark):
    hosts = spark.createDataFrame([(i, g) for i, g in enumerate((6.9, 7.0, 12.0, 24.0))], "h int, total_gb double")
    got = {(r.h, r.role): r.option for r in K.first_fit(hosts, ["h"]).collect()}
    assert [got[i, "orchestrator"] for i in range(4)] == ["small", "small", "medium", "large"] and got[0, "vision"] == "fallback" and got[2, "vision"] == "primary"


def test_models_never_fail_a_job(spark):
    df = spark.createDataFrame([(0, "even"), (1, "odd"), (2, None)], "i int, t string")
    got = {r.i: r for r in X.cascade(df, "t", [M.failing_stub, M.ocr_stub], "o").collect()}
    assert got[0].o == "[first] even" and got[0].engine == 0 and got[1].o == "[ocr] odd" and got[1].engine == 1

    def broken(batch):
        raise OSError("gone")

    bad = M.run_model(df, "t", broken, M.TEXT, "r").collect()
    assert all(not r.r.ok and r.r.error == "OSError: gone" for r in bad)
    judged = J.merge_verdict(M.run_model(df.withColumn("md", F.lit("x" * 17)), "md", M.judge_stub, M.VERDICT, "v"), "v", F.lit(True)).first()
    assert judged.judge_level == "L4-fallback" and judged.action == "patch" and judged.content_score == 5.0


def test_routes(spark):
    rows = [(0, "scanned", "text"), (1, "mixed", "It seems odd"), (2, None, "own"), (3, "table_heavy", "text")]
    pages = spark.createDataFrame(rows, "page_num int, page_type string, text string").withColumn("tables_md", F.when(F.col("page_num") == 3, F.array(F.lit("|t|"))).otherwise(F.array().cast("array<string>")))
    no = F.lit(False)
    routed = pages.withColumn("route", P.route(F.col("page_type"), F.lit(True), no, no, no, no))
    assert [r.route for r in routed.orderBy("page_num").collect()] == ["scanned", "mixed", "text_rich", "table_heavy"]

    def remark(batch):
        return ["It seems this is a page"] * len(batch)

    got = X.extract(routed, M.STUBS | {"mixed": remark}).withColumn("d", F.lit(1))
    assert R.join_pages(got, "d").first().md == "[ocr] text\n\n---\n\nIt seems odd\n\n---\n\n[vision] own\n\n---\n\n|t|"
    order = [one(spark, P.route(F.lit("mixed"), F.lit(v), F.lit(po), F.lit(ex), F.lit(sl), F.lit(la))) for v, po, ex, sl, la in ((1 > 0, True, True, True, True), (True, False, True, True, True), (True, False, False, True, True), (True, False, False, False, True), (False, True, False, True, False))]
    assert order == ["poster", "exam", "slide", "layout", "fallback"]


def test_pages_without_text_as_in_sql(spark, tmp_path):
    """An empty page keeps its step's mark and blank, a null one is left out, as in the SQL of route_dispatch."""
    import duckdb

    from quillmill.queries import ORACLES, QUERIES

    rows = [(i, t, "en", "ab"[i // 20]) for i, t in enumerate(["", None, "text", " ", "\x1cx "] * 4 + [None] * 2)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = dict(duck.execute(ORACLES["route_dispatch"]).fetchall())
    assert "[ocr] \n" in want["a"] and want["b"] is None
    assert {r.source: r.md for r in QUERIES["route_dispatch"](spark, str(tmp_path)).collect()} == want


def test_layout_route(spark):
    glyphs = "/g1a /gff /g0b a b"
    el = [(0, 1, "text", "body"), (0, 0, "title", "T"), (0, 2, "footnote", "n"), (1, 0, "text", " "), (3, 0, "text", glyphs), (4, 0, "text", glyphs), (5, 0, "text", glyphs), (6, 0, "text", "not asked")]
    el = spark.createDataFrame(el, "page_num int, ord int, label string, text string").withColumn("table_md", F.lit(""))
    rows = [(i, "layout", f"own {i}", i != 4) for i in range(5)] + [(5, "layout", "fails", True), (6, None, "own 6", True)]
    pages = spark.createDataFrame(rows, "page_num int, route string, text string, sees boolean").withColumn("tables_md", F.array(F.lit("|t|"), F.lit(" ")))

    def vision(batch):
        return [RuntimeError("no") if t == "fails" else "[vision] " + t for t in batch]

    own = lambda x: f"{x}\n\n{R.TABLES_MARK}\n\n|t|"
    whole = X.extract(pages, {"image_heavy": vision}, el, ["page_num"], F.col("sees"))
    assert set(whole.columns) == {*pages.columns, "md"}
    got = {r.page_num: r.md for r in whole.collect()}
    assert got == {0: "# T\n\nbody\n\n---\n**Footnotes**\n\n- n", 1: own("own 1"), 2: own("own 2"), 3: "[vision] own 3\n\n|t|", 4: glyphs, 5: own("fails"), 6: own("own 6")}
    assert {r.page_num: r.md for r in X.extract(pages, {}, el, ["page_num"]).collect()}[3] == glyphs


def test_answers_keep_tables(spark):
    kinds = ("text_rich", "image_heavy", "mixed", "poster", "slide", "exam", "scanned")
    pages = spark.createDataFrame([(k, "own") for k in kinds], "route string, text string").withColumn("tables_md", F.array(F.lit("|t|"), F.lit(" ")))
    got = {r.route: r.md for r in X.extract(pages, M.STUBS).collect()}
    tables = f"\n\n{R.TABLES_MARK}\n\n|t|"
    assert got == {
        "text_rich": "[vision] own" + tables, "image_heavy": "[vision] own\n\n|t|", "mixed": f"own{tables}\n\n[vision] own",
        "poster": "[vision] own", "slide": "[vision] own", "exam": "[exam] own", "scanned": "[ocr] own",
    }


def test_all_routes_over_documents(spark, sf):
    from quillmill.queries import QUERIES
    from quillmill.queries.analysis import elements
    from quillmill.queries.documents import _routed

    routed = _routed(spark, sf).withColumn("tables_md", F.array().cast("array<string>"))
    md = {r.source: r.md for r in R.join_pages(X.extract(routed, M.STUBS, elements(spark, sf), ["doc_id"]), "source").collect()}
    laid = {r.doc_id: r.md for r in QUERIES["elements_to_markdown"](spark, sf).collect()}
    want, seen = {}, set()
    for r in sorted(routed.select("source", "doc_id", "page_num", "route", "text").collect(), key=lambda r: r.page_num):
        text = r.text.strip()
        own = {"exam": f"[exam] {text}", "scanned": f"[ocr] {text}", "mixed": f"{text}\n\n[vision] {text}", "layout": laid[r.doc_id] or text}
        want.setdefault(r.source, []).append(own.get(r.route, text if r.route in ("table_heavy", "fallback") else f"[vision] {text}"))
        seen.add(r.route)
    assert {"layout", "poster", "exam", "slide", "mixed", "table_heavy"} <= seen
    assert md == {s: "\n\n---\n\n".join(x) for s, x in want.items()}


def test_quality_loop_keeps_the_earliest_best(spark):
    df = spark.createDataFrame([(0, "alpha beta gamma", "## H\nalpha beta gamma"), (1, "alpha beta gamma delta", "## H\nalpha")], "k int, text string, md string")
    got = {r.k: r for r in X.quality_loop(df, "k").collect()}
    assert got[0].round_num == 1 and got[0].action == "accept" and got[1].round_num == 2 and got[1].score > 8


def test_files(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/b.pdf").write_bytes(b"12")
    (tmp_path / "in/sub/a.pdf").write_bytes(b"123")
    (tmp_path / "in/c.txt").write_bytes(b"no")
    assert [(os.path.basename(r.pdf), r.size) for r in Z.discover(spark, str(tmp_path / "in")).collect()] == [("b.pdf", 2), ("a.pdf", 3)]

    def reader(path, content):
        if len(content) == 2:
            raise ValueError("broken")
        return M.page_stub(path, content)

    got = {os.path.basename(r.pdf): r for r in Z.scan_documents(spark, str(tmp_path / "in"), "*.pdf", reader).collect()}
    assert got["a.pdf"].text == "3 bytes" and got["b.pdf"].error == "ValueError: broken" and got["b.pdf"].text is None
    docs = spark.createDataFrame([("x", "# X\ntext"), ("y", "Y")], "doc string, md string")
    S.write_markdown(docs, str(tmp_path / "md"))
    S.write_markdown(docs.where("doc = 'x'").withColumn("md", F.lit("new")), str(tmp_path / "md"))
    text = {p.split("doc=")[1].split("/")[0]: open(p).read().strip() for p in glob.glob(f"{tmp_path}/md/doc=*/*.txt")}
    assert text == {"x": "new", "y": "Y"}
    parsed = spark.createDataFrame([("x",), ("y",)], "doc string")
    S.write_flagged(spark.createDataFrame([("x", "r"), ("y", "r")], "doc string, report string"), parsed, str(tmp_path / "fl"))
    S.write_flagged(spark.createDataFrame([], "doc string, report string"), parsed.where("doc = 'x'"), str(tmp_path / "fl"))
    text = {p.split("doc=")[1].split("/")[0]: open(p).read().strip() for p in glob.glob(f"{tmp_path}/fl/doc=*/*.txt")}
    assert text == {"y": "r"}  # a stale report is deleted


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pdf").write_bytes(b"1")
    seen = []

    def go():
        q = D.track(D.watch(spark, str(tmp_path / "in")), str(tmp_path / "reg"), str(tmp_path / "cp"), lambda new: seen.extend(r.pdf for r in new.collect()))
        q.awaitTermination(60)
        return sorted(os.path.basename(r.pdf) for r in Z.load_registry(spark, str(tmp_path / "reg")).collect())

    assert go() == ["a.pdf"]
    (tmp_path / "in/b.pdf").write_bytes(b"2")
    assert go() == ["a.pdf", "b.pdf"] and [os.path.basename(p) for p in seen] == ["a.pdf", "b.pdf"]
    rows = [(1, T0), (1, T0 + dt.timedelta(seconds=150)), (1, T0 + dt.timedelta(seconds=301)), (2, T0)]
    df = spark.createDataFrame(rows, "k int, ts timestamp")
    got = D.stalls(df, "k", "ts").collect()
    assert [(r.k, r.seconds) for r in got] == [(1, 151)]
    assert pytest.approx(D.live_sessions(df, "k", "ts", 200).count()) == 2
