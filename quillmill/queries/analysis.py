"""Queries over pages, documents, layouts and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.operators import judge as J
from quillmill.operators import layout as G
from quillmill.operators import profile as P
from quillmill.operators import render as R
from quillmill.queries.base import MD, PAGES, TYPE_SQL, markdown, pages, query, strip_sql, table
from quillmill.queries.text import words_sql

# ---- fixtures: layout elements made up from documents ----

LABELS = ("title", "section_header", "text", "list_item", "table", "picture", "formula", "footnote", "paragraph")
_LABEL = "CASE (doc_id + ord) % 9 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(LABELS)) + " END"
_TMD = "CASE WHEN (doc_id + ord) % 9 = 4 THEN '| a | '||lang||' |'||chr(10)||'|---|---|' ELSE '' END"
EL = f"el AS (SELECT doc_id, ord, {_LABEL} AS label, cast(ord % 4 AS integer) AS level, trim(substr(text, ord * 20 + 1, 20)) AS text, {_TMD} AS table_md FROM (SELECT *, unnest(generate_series(0, doc_id % 12)) AS ord FROM documents))"


def elements(spark, d):
    rows = table(spark, d, "documents").withColumn("ord", F.explode(F.sequence(F.lit(0).cast("long"), F.col("doc_id") % 12)))
    return rows.select("doc_id", "ord", F.expr(_LABEL).alias("label"), F.expr("cast(ord % 4 as int)").alias("level"), F.expr("trim(substr(text, cast(ord * 20 + 1 as int), 20))").alias("text"), F.expr(_TMD).alias("table_md"))


#: Block boxes from lineitem: a page an order, lines its blocks.
_BLOCK = "l_orderkey, l_linenumber AS ord, l_quantity * 10 AS x0, l_extendedprice / 100 AS y0, l_quantity * 10 + l_discount * 4000 AS x1, l_extendedprice / 100 + l_tax * 3000 AS y1, CASE WHEN l_returnflag = 'R' THEN 'image' ELSE 'text' END AS block_type"
BL = f"bl AS (SELECT {_BLOCK}, 600.0::DOUBLE AS width, 800.0::DOUBLE AS height FROM lineitem)"


def blocks(spark, d):
    cols = _BLOCK.split(", ")
    return table(spark, d, "lineitem").selectExpr(*cols, "cast(600 as double) AS width", "cast(800 as double) AS height")


# ---- pages and documents ----


@query("image_area_ratio", f"WITH {BL} SELECT l_orderkey, least(1.0::DOUBLE, sum(CASE WHEN block_type = 'image' THEN greatest(0.0::DOUBLE, (x1 - x0) * (y1 - y0)) ELSE 0.0::DOUBLE END) / 480000.0) AS ratio FROM bl GROUP BY l_orderkey")
def image_area_ratio(spark, d):
    return P.image_area_ratio(blocks(spark, d), ["l_orderkey"])


@query("page_classify", f"WITH {PAGES} SELECT doc_id, {TYPE_SQL} AS page_type FROM pg")
def page_classify(spark, d):
    return P.page_profile(pages(spark, d)).select("doc_id", "page_type")


@query("page_profile", f"WITH {PAGES} SELECT source, page_num, text_length, round(ratio, 3) AS image_area_ratio, tables AS table_count, page_type, page_type = 'scanned' AS needs_ocr, page_type IN ('image_heavy', 'mixed') AS needs_vision FROM (SELECT *, {TYPE_SQL} AS page_type FROM pg)")
def page_profile(spark, d):
    return P.page_profile(pages(spark, d)).select("source", F.col("page_num").cast("long").alias("page_num"), "text_length", "image_area_ratio", F.col("tables").alias("table_count"), "page_type", "needs_ocr", "needs_vision")


@query("refine_vision", f"WITH {PAGES}, {EL} SELECT doc_id, coalesce(v, false) AS needs_vision FROM pg LEFT JOIN (SELECT doc_id, bool_or(label = 'picture') AS v FROM el GROUP BY doc_id) USING (doc_id)")
def refine_vision(spark, d):
    return P.refine_vision(P.page_profile(pages(spark, d)), elements(spark, d), ["doc_id"]).select("doc_id", "needs_vision")


def _grouped(spark, d, per):
    """Pages in made-up documents of so many pages."""
    return pages(spark, d).withColumns({"doc": F.expr(f"doc_id div {per}"), "page": F.col("doc_id")})


@query("detect_poster", f"WITH {EL}, n AS (SELECT doc_id, count(*) AS n FROM el WHERE label IN ('text', 'section_header', 'list_item', 'paragraph') GROUP BY doc_id) SELECT doc_id // 4 AS doc, count(*) <= 5 AND bool_or(length(text) > 800 AND coalesce(n, 0) < 4 + 4) AS poster FROM documents LEFT JOIN n USING (doc_id) GROUP BY 1")
def detect_poster(spark, d):
    el = elements(spark, d).withColumns({"doc": F.expr("doc_id div 4"), "page": F.col("doc_id")})
    return P.detect_poster(_grouped(spark, d, 4), el, "doc", "page")


_EXAMS = "CASE doc_id % 40 WHEN 3 THEN 'GATE 2024 ' WHEN 17 THEN 'q.12 ' WHEN 31 THEN 'PART A 20 Marks' ELSE '' END||substr(text, 1, 40)"


_MARKS = r"(?i)Maximum\s+Marks|Q[.]?\s*[0-9]+\b|(GATE|ESE|IES)\s+[0-9]{4}|UPSC\s+(IES|ESE)|JEE.{0,20}(Main|Advanced)|(PART|PAPER)\s+[0-9A-Z]\b.*Marks"


@query("detect_exam", f"SELECT doc_id // 8 AS doc, bool_or(regexp_matches(t, '{_MARKS}') AND n <= 5) AS exam FROM (SELECT doc_id, {_EXAMS} AS t, row_number() OVER (PARTITION BY doc_id // 8 ORDER BY doc_id) AS n FROM documents) GROUP BY 1")
def detect_exam(spark, d):
    return P.detect_exam(_grouped(spark, d, 8).join(table(spark, d, "documents").select("doc_id", F.expr(_EXAMS).alias("exam_text")), "doc_id").withColumn("text", F.col("exam_text")), "doc", "page")


@query("pages_by_type", f"WITH {PAGES} SELECT page_type, count(*) AS n FROM (SELECT {TYPE_SQL} AS page_type FROM pg) GROUP BY page_type")
def pages_by_type(spark, d):
    return P.page_profile(pages(spark, d)).groupBy("page_type").agg(F.count("*").alias("n"))


_SHARES = ", ".join(f"round(count(*) FILTER (page_type = '{t}') / count(*)::DOUBLE, 3) AS share_{t}" for t in P.PAGE_TYPES)
DP = f"""dp AS (SELECT *, CASE WHEN vision_share < 0.05 THEN 'none' WHEN vision_share < 0.2 THEN 'low' WHEN vision_share < 0.5 THEN 'medium' ELSE 'high' END AS vision_dependency,
 round(0.30::DOUBLE * share_table_heavy + 0.25::DOUBLE * share_image_heavy + 0.20::DOUBLE * share_mixed + 0.15::DOUBLE * share_scanned + 0.10::DOUBLE * least(1.0::DOUBLE, page_count / 500::DOUBLE), 3) AS complexity,
 CASE WHEN page_count < 50 THEN 'small' WHEN page_count < 200 THEN 'medium' WHEN page_count < 500 THEN 'large' ELSE 'huge' END AS size_tier
 FROM (SELECT *, share_image_heavy + share_mixed + share_scanned AS vision_share FROM (SELECT source, count(*) AS page_count, {_SHARES}, 0::BIGINT AS formula_count FROM (SELECT *, {TYPE_SQL} AS page_type FROM pg) GROUP BY source)))"""


@query("doc_profile", f"WITH {PAGES}, {DP} SELECT * FROM dp")
def doc_profile(spark, d):
    return P.doc_profile(P.page_profile(pages(spark, d)), "source")


@query("doc_profile_layout", f"""WITH {PAGES}, {EL}, k AS (SELECT source, count(DISTINCT CASE WHEN label = 'picture' THEN doc_id END) AS pictures, count(*) FILTER (label = 'formula') AS formula_count FROM el JOIN documents USING (doc_id) GROUP BY source)
SELECT source, count(*) AS page_count, any_value(pictures) / count(*)::DOUBLE AS vision_share, any_value(formula_count) AS formula_count, CASE WHEN any_value(pictures) / count(*)::DOUBLE < 0.05 THEN 'none' WHEN any_value(pictures) / count(*)::DOUBLE < 0.2 THEN 'low' WHEN any_value(pictures) / count(*)::DOUBLE < 0.5 THEN 'medium' ELSE 'high' END AS vision_dependency FROM pg JOIN k USING (source) GROUP BY source""")
def doc_profile_layout(spark, d):
    el = elements(spark, d).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return P.doc_profile(P.page_profile(pages(spark, d)), "source", el, "doc_id").select("source", "page_count", "vision_share", "formula_count", "vision_dependency")


_PLAN = """SELECT source, page_count, CASE WHEN vision_dependency = 'none' THEN CASE WHEN ex OR po THEN CASE WHEN po THEN 'primary' ELSE 'fallback' END ELSE 'none' END WHEN vision_dependency = 'low' AND NOT po THEN 'fallback' ELSE 'primary' END AS model_tier,
greatest(1, CASE size_tier WHEN 'small' THEN 4 WHEN 'medium' THEN 3 WHEN 'large' THEN 2 ELSE 1 END + CASE WHEN complexity > 0.6 THEN 1 WHEN complexity < 0.3 THEN -1 ELSE 0 END) AS max_rounds,
CASE size_tier WHEN 'small' THEN 1.0 WHEN 'medium' THEN 0.6 WHEN 'large' THEN 0.3 ELSE 0.1 END::DOUBLE AS judge_sample_rate, false AS use_math_ocr, 'none' AS math_engine,
share_image_heavy + share_mixed >= 0.7 AND page_count >= 5 AND size_tier IN ('small', 'medium') AS slide_mode, ex AS exam_mode, po AS poster_mode, true AS use_layout FROM (SELECT *, page_count % 2 = 0 AS ex, page_count % 3 = 0 AS po FROM dp)"""


@query("parse_plan", f"WITH {PAGES}, {DP} {_PLAN}")
def parse_plan(spark, d):
    plan = P.parse_plan(doc_profile(spark, d), F.lit(True), F.col("page_count") % 2 == 0, F.col("page_count") % 3 == 0, F.lit(True), F.lit(True))
    return plan.select("source", "page_count", "model_tier", "max_rounds", "judge_sample_rate", "use_math_ocr", "math_engine", "slide_mode", "exam_mode", "poster_mode", "use_layout")


# ---- geometry ----


@query("spatial_sort", f"WITH {BL} SELECT l_orderkey, ord, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN NOT sp AND NOT le THEN 1 ELSE 0 END, y0, CASE WHEN le THEN 1 ELSE 0 END, ord, x0) - 1 AS reading_order FROM (SELECT *, x1 - x0 > width * 0.55::DOUBLE AS sp, NOT (x1 - x0 > width * 0.55::DOUBLE) AND (x0 + x1) / 2 < width / 2 AS le FROM bl)")
def spatial_sort(spark, d):
    return G.spatial_sort(blocks(spark, d), ["l_orderkey"], F.col("width")).select("l_orderkey", "ord", "reading_order")


@query("classify_region", f"WITH {BL} SELECT l_orderkey, ord, w_px, h_px, CASE WHEN w_px / h_px::DOUBLE > 2.5 AND w_px > 300 THEN 'ecg' WHEN w_px > 200 AND h_px > 150 THEN 'diagram' ELSE 'figure' END AS label FROM (SELECT *, floor((x1 - x0) * 150 / 72)::INT AS w_px, floor((y1 - y0) * 150 / 72)::INT AS h_px FROM bl WHERE block_type = 'image' AND x1 - x0 >= 36 AND y1 - y0 >= 36) WHERE w_px * h_px * 3 >= 5000")
def classify_region(spark, d):
    return G.detect_regions(blocks(spark, d)).select("l_orderkey", "ord", "w_px", "h_px", "label")


_WH = "cast(l_quantity * 20 AS INT) AS w, cast(l_linenumber * 150 AS INT) AS h"


@query("image_type", f"SELECT l_orderkey, l_linenumber, CASE WHEN w / h::DOUBLE > 2.5 AND w > 400 THEN 'ecg' WHEN w > 600 AND h > 400 THEN 'diagram' ELSE 'generic' END AS kind FROM (SELECT l_orderkey, l_linenumber, {_WH} FROM lineitem)")
def image_type(spark, d):
    rows = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", *_WH.split(", "))
    return rows.select("l_orderkey", "l_linenumber", G.image_type(F.col("w"), F.col("h")).alias("kind"))


@query("pdf_type", f"WITH i AS (SELECT l_orderkey, {_WH}, l_suppkey % 10 AS size_kb FROM lineitem) SELECT o_orderkey, CASE WHEN large IS NULL THEN 'A' WHEN large THEN 'C' ELSE 'B' END AS pdf_type FROM orders LEFT JOIN (SELECT l_orderkey, bool_or(w >= 400) AS large FROM i WHERE size_kb >= 5 AND w >= 100 AND h >= 80 GROUP BY 1) ON o_orderkey = l_orderkey")
def pdf_type(spark, d):
    images = table(spark, d, "lineitem").selectExpr("l_orderkey AS o_orderkey", *_WH.split(", "), "l_suppkey % 10 AS size_kb")
    return G.pdf_type(images, ["o_orderkey"], table(spark, d, "orders").select("o_orderkey"))


_BOX = "l_discount * 5 AS l, l_tax * 5 AS t, l_discount * 5 + l_tax AS r, l_tax * 6 AS b"


@query("crop_box", f"SELECT l_orderkey, l_linenumber, CASE WHEN ok THEN x0 END AS x0, CASE WHEN ok THEN y0 END AS y0, CASE WHEN ok THEN x1 END AS x1, CASE WHEN ok THEN y1 END AS y1 FROM (SELECT *, r > l AND b > t AND x1 - x0 >= 4 AND y1 - y0 >= 4 AS ok FROM (SELECT l_orderkey, l_linenumber, l, t, r, b, floor(l * 1000)::INT AS x0, floor(t * 800)::INT AS y0, floor(r * 1000)::INT AS x1, floor(b * 800)::INT AS y1 FROM (SELECT *, {_BOX} FROM lineitem)))")
def crop_box(spark, d):
    rows = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", *_BOX.split(", "))
    box = G.crop_box(F.col("l"), F.col("t"), F.col("r"), F.col("b"), F.lit(1000), F.lit(800))
    return rows.select("l_orderkey", "l_linenumber", box.alias("c")).select("l_orderkey", "l_linenumber", "c.x0", "c.y0", "c.x1", "c.y1")


@query("resize_dims", f"SELECT l_orderkey, l_linenumber, CASE WHEN e > 512 THEN floor(w * (512.0::DOUBLE / e))::INT ELSE w END AS w, CASE WHEN e > 512 THEN floor(h * (512.0::DOUBLE / e))::INT ELSE h END AS h FROM (SELECT l_orderkey, l_linenumber, w, h, greatest(w, h) AS e FROM (SELECT *, {_WH} FROM lineitem))")
def resize_dims(spark, d):
    rows = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", *_WH.split(", "))
    return rows.select("l_orderkey", "l_linenumber", G.resize_dims(F.col("w"), F.col("h"), 512).alias("s")).select("l_orderkey", "l_linenumber", "s.w", "s.h")


_SPANS = "CASE WHEN doc_id % 7 = 0 THEN 'image' ELSE 'text' END AS block_type"


@query("blocks_from_lines", f"SELECT doc_id, block_type, CASE WHEN block_type = 'image' THEN '' ELSE tx END AS text FROM (SELECT doc_id, block_type, {strip_sql("array_to_string(list_filter(list_transform(string_split('ﬁ'||text, chr(10)), lambda x: " + strip_sql('replace(x, ' + chr(39) + '.' + chr(39) + ', ' + chr(39) * 2 + ')') + "), lambda x: x <> ''), chr(10))").replace("'ﬁ'", "'fi'")} AS tx FROM (SELECT doc_id, text, {_SPANS} FROM documents)) WHERE block_type = 'image' OR tx <> ''")
def blocks_from_lines(spark, d):
    # Spans of a line: what lies between full stops.
    lines = F.transform(F.split(F.concat(F.lit("ﬁ"), "text"), r"\n", -1), lambda x: F.split(x, r"\.", -1))
    return G.blocks_from_lines(table(spark, d, "documents").select("doc_id", F.expr(_SPANS.split(" AS ")[0]).alias("block_type"), lines.alias("lines"))).select("doc_id", "block_type", "text")


#: Blocks of raw pages as elements: headings, paragraphs, items, and the footer, which goes.
_TAGS = r"<(?:h1|p|li|footer)>(?:<b>|<a [^>]*>)*[^<]*"
_HTML_LABEL = "CASE WHEN starts_with(e, '<h1') THEN 'title' WHEN starts_with(e, '<li') THEN 'list_item' WHEN starts_with(e, '<footer') THEN 'page_footer' ELSE 'text' END"


@query("layout_elements", f"SELECT page_id, pos, label, txt AS text, row_number() OVER (PARTITION BY page_id ORDER BY t, l, pos) - 1 AS ord FROM (SELECT page_id, pos, {_HTML_LABEL} AS label, regexp_replace(e, '<[^>]*>', '', 'g') AS txt, (pos % 7) / 5.0::DOUBLE AS l0, least(1.0::DOUBLE, (pos // 3) / 10.0::DOUBLE) AS t, least(1.0::DOUBLE, (pos % 7) / 5.0::DOUBLE) AS l FROM (SELECT page_id, i - 1 AS pos, es[i] AS e FROM (SELECT page_id, es, unnest(generate_series(1, len(es))) AS i FROM (SELECT page_id, regexp_extract_all(html, '{_TAGS}') AS es FROM pages)))) WHERE label <> 'page_footer'")
def layout_elements(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(_TAGS), F.lit(0))).alias("pos", "e"))
    label = F.when(F.startswith("e", F.lit("<h1")), "title").when(F.startswith("e", F.lit("<li")), "list_item").when(F.startswith("e", F.lit("<footer")), "page_footer").otherwise("text")
    rows = rows.select("page_id", F.col("pos").cast("long").alias("pos"), label.alias("label"), F.regexp_replace("e", "<[^>]*>", "").alias("text"), ((F.col("pos") % 7) / 5.0).alias("l"), (F.expr("pos div 3") / 10.0).alias("t"), F.lit(1.5).alias("r"), F.lit(-0.5).alias("b"))
    return G.layout_order(rows, ["page_id"]).select("page_id", "pos", "label", "text", F.col("ord").cast("long").alias("ord"))


# ---- scores ----

_N = lambda x, p: f"len(regexp_extract_all({x}, '{p}'))"


def structure_sql(x: str) -> str:
    fences, meta = _N(x, "(?m)^```"), _N(x, J.META_HEADERS.replace("(?imd)", "(?im)"))
    return (
        f"greatest(0.0::DOUBLE, least(10.0::DOUBLE, 8.0::DOUBLE + CASE WHEN regexp_matches({x}, '(?m)^#{{1,4}}\\s+\\S') THEN 1 ELSE 0 END + CASE WHEN regexp_matches({x}, '(?m)^[|][:\\s]*[:-]{{3,}}[:\\s]*[|]') THEN 1 ELSE 0 END"
        f" - CASE WHEN {_N(x, '(?i)\\bpage\\s+[0-9]+\\s+of\\s+[0-9]+\\b')} > 1 THEN 2 ELSE 0 END - CASE WHEN length({x}) > 500 AND NOT regexp_matches({x}, '(?m)^##\\s+') THEN 1 ELSE 0 END"
        f" - CASE WHEN {fences} > 2 THEN least(3.0::DOUBLE, ({fences} - 2) * 0.5::DOUBLE) ELSE 0 END - least(2.0::DOUBLE, {meta} * 0.5::DOUBLE)))"
    )


_META = "CASE WHEN doc_id % 3 = 0 THEN text ELSE m||chr(10)||repeat('```'||chr(10), cast(doc_id % 9 AS int))||'## Visual Content'||chr(10)||'# text transcription x' END"


@query("structure_score", f"WITH {MD} SELECT doc_id, {structure_sql('x')} AS structure_score FROM (SELECT doc_id, {_META} AS x FROM md)")
def structure_score(spark, d):
    return markdown(spark, d).select("doc_id", J.structure_score(F.expr(_META)).alias("structure_score"))


_W = "CASE label " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in J.WEIGHTS.items()) + " END"
_FOUND = f"least(want, CASE WHEN label = 'table' THEN {_N('m', '(?m)^[|][:\\s]*[:-]{3,}[:\\s]*[|]')} WHEN label = 'formula' THEN {_N('m', J.FORMULA)} WHEN label = 'picture' THEN {_N('m', '!\\[')} WHEN label IN ('section_header', 'title') THEN {_N('m', '(?m)^#{1,4}\\s+\\S')} WHEN length({strip_sql('m')}) > 20 THEN want ELSE 0 END)"
COV = f"cov AS (SELECT doc_id, round(sum({_W} * {_FOUND}) / sum({_W} * want), 3) AS coverage FROM (SELECT doc_id, label, count(*) AS want FROM el WHERE label IN ({', '.join(repr(k) for k in J.WEIGHTS)}) GROUP BY ALL) JOIN md USING (doc_id) GROUP BY doc_id)"


def _covered(spark, d):
    return J.layout_coverage(elements(spark, d), markdown(spark, d).select("doc_id", F.col("m").alias("md")), ["doc_id"])


@query("judge_l1_coverage", f"WITH {MD}, {EL}, {COV} SELECT doc_id, coalesce(coverage, 1.0::DOUBLE) AS coverage FROM md LEFT JOIN cov USING (doc_id)")
def judge_l1_coverage(spark, d):
    return _covered(spark, d).select("doc_id", "coverage")


L2 = f"""l2 AS (SELECT doc_id, source, text, m, ns, nb, rate AS hallucination_rate, CASE WHEN ns > 0 THEN CASE WHEN rate > 0.2 THEN greatest(0.0::DOUBLE, c - rate * 4) ELSE c END ELSE 5.0::DOUBLE END AS content_score, structure_score FROM
 (SELECT *, least(10.0::DOUBLE, nb / ns::DOUBLE * 10) AS c, CASE WHEN ns > 0 AND nm > 0 THEN (nm - nb) / nm::DOUBLE ELSE 0.0::DOUBLE END AS rate, {structure_sql('m')} AS structure_score FROM
 (SELECT doc_id, source, text, m, len(s) AS ns, len(w) AS nm, len(list_intersect(s, w)) AS nb FROM (SELECT *, {words_sql('text')} AS s, {words_sql('m')} AS w FROM (SELECT doc_id, source, text, {"CASE WHEN doc_id % 2 = 0 THEN m ELSE left(m, 300)||' invented words here' END"} AS m FROM md)))))"""
def _cut_md():
    return F.when(F.col("doc_id") % 2 == 0, F.col("m")).otherwise(F.concat(F.left(F.col("m"), F.lit(300)), F.lit(" invented words here"))).alias("md")


def scored(spark, d):
    return J.heuristic(markdown(spark, d).select("doc_id", "source", "text", _cut_md()))


_SCORE = "round(0.7::DOUBLE * content_score + 0.3::DOUBLE * structure_score, 1)"
_CONF = f"CASE WHEN {_SCORE} >= 8 THEN 'High' WHEN {_SCORE} >= 5 THEN 'Medium' ELSE 'Low' END"
_ACT = f"CASE WHEN {_SCORE} >= 8 THEN 'accept' WHEN {_SCORE} >= 5 THEN 'patch' ELSE 'fallback' END"


@query("judge_l2", f"WITH {MD}, {L2} SELECT doc_id, content_score, structure_score, hallucination_rate, 0.7::DOUBLE * content_score + 0.3::DOUBLE * structure_score AS blend, {_CONF} AS confidence, {_ACT} AS action FROM l2")
def judge_l2(spark, d):
    # The blend before rounding: the engines round ties apart.
    blend = (0.7 * F.col("content_score") + 0.3 * F.col("structure_score")).alias("blend")
    return scored(spark, d).select("doc_id", "content_score", "structure_score", "hallucination_rate", blend, "confidence", "action")


@query("judge_l1_l2", f"WITH {MD}, {EL}, {COV}, {L2} SELECT doc_id, coverage, least(content_score, coverage * 10 + 1) AS content_score FROM l2 JOIN cov USING (doc_id)")
def judge_l1_l2(spark, d):
    md = markdown(spark, d).select("doc_id", "source", "text", _cut_md())
    cov = J.layout_coverage(elements(spark, d), markdown(spark, d).select("doc_id", F.col("m").alias("md")), ["doc_id"])
    has = elements(spark, d).where(F.col("label").isin(*J.WEIGHTS)).select("doc_id").distinct()
    return J.heuristic(md.join(cov, "doc_id").join(has, "doc_id", "left_semi"), F.col("coverage"), F.col("layout_gaps")).select("doc_id", "coverage", "content_score")


@query("round_aggregate", f"WITH {MD}, {L2} SELECT source, round(avg(s), 1) AS score, CASE WHEN bool_or(a = 'fallback') THEN 'fallback' WHEN round(avg(s), 1) >= 8 THEN 'accept' ELSE 'patch' END AS action, count(*) FILTER (hallucination_rate > 0.2) AS n_gaps FROM (SELECT *, {_SCORE} AS s, {_ACT} AS a FROM l2) GROUP BY source")
def round_aggregate(spark, d):
    return J.round_aggregate(scored(spark, d), ["source"], "doc_id").select("source", "score", "action", F.size("gaps").cast("long").alias("n_gaps"))


_DM = f"""WITH {MD}, {L2}, raw AS (SELECT source, list_distinct(flatten(list({words_sql('text')}))) AS r, round(avg({_SCORE}), 1) AS judge_score, round(count(*) FILTER ({_SCORE} >= 8) / count(*)::DOUBLE, 2) AS coverage_rate FROM l2 GROUP BY source),
one AS (SELECT source, arg_min(m, doc_id) AS m FROM md GROUP BY source)
SELECT source, judge_score, coverage_rate, round(len(list_intersect(r, {words_sql('m')})) / len(r)::DOUBLE, 2) AS completeness, {_N('m', '(?m)^#{1,6}\\s+\\S')} AS heading_count, {_N('m', '(?m)^[|][:\\s]*[:-]+[:\\s]*[|]')} AS table_count, true AS judged FROM raw JOIN one USING (source)"""


def metrics(spark, d):
    one = markdown(spark, d).groupBy("source").agg(F.min_by("m", "doc_id").alias("md"))
    return J.doc_metrics(scored(spark, d), one, "source")


@query("doc_metrics", _DM)
def doc_metrics(spark, d):
    m = metrics(spark, d)
    return m.withColumns({"heading_count": F.col("heading_count").cast("long"), "table_count": F.col("table_count").cast("long")})


#: Rounds of scores from orders: a page a customer, a round an order of theirs.
_ROUNDS = "rd AS (SELECT o_custkey AS page, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS round_num, (cast(floor(o_totalprice) AS BIGINT) % 101) / 10.0::DOUBLE AS score FROM orders)"


def _rounds(spark, d):
    from pyspark.sql import Window

    return table(spark, d, "orders").select(F.col("o_custkey").alias("page"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long").alias("round_num"), ((F.floor("o_totalprice") % 101) / 10.0).alias("score"))


@query("best_round", f"WITH {_ROUNDS} SELECT page, round_num, score FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, round_num) AS n FROM rd WHERE score > 0) WHERE n = 1")
def best_round(spark, d):
    return J.best_round(_rounds(spark, d), ["page"])


@query("judge_carryover", f"WITH {_ROUNDS} SELECT page, arg_max(score, round_num) AS score FROM rd GROUP BY page HAVING max(score) >= 9")
def judge_carryover(spark, d):
    return J.carryover(_rounds(spark, d), ["page"])


@query("judge_sample", f"WITH {PAGES} SELECT source, doc_id FROM (SELECT *, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN page_type IN ('image_heavy', 'mixed', 'scanned') THEN 0 ELSE 1 END, md5('13:'||source||':'||doc_id)) AS k FROM (SELECT *, {TYPE_SQL} AS page_type FROM pg)) WHERE k <= greatest(1, floor(n * 0.3::DOUBLE))")
def judge_sample(spark, d):
    return J.judge_sample(P.page_profile(pages(spark, d)), "source", "doc_id", F.lit(0.3)).select("source", "doc_id")


@query("element_checklist", f"WITH {EL} SELECT doc_id, string_agg('  - '||n||'x '||CASE label WHEN 'section_header' THEN 'section heading' WHEN 'title' THEN 'document title' WHEN 'picture' THEN 'figure/image' WHEN 'formula' THEN 'equation/formula' WHEN 'list_item' THEN 'list item' WHEN 'text' THEN 'text block' ELSE label END, chr(10) ORDER BY label) AS checklist FROM (SELECT doc_id, label, count(*) AS n FROM el GROUP BY ALL) GROUP BY doc_id")
def element_checklist(spark, d):
    return J.element_checklist(elements(spark, d), ["doc_id"])


_JSON = ("CASE doc_id % 6 WHEN 0 THEN '{\"score\": '||cast(doc_id % 10 AS {S})||'.5, \"action\": \"fallback\"}' WHEN 1 THEN 'so: {\"score\": '||cast(doc_id % 10 AS {S})||', \"action\": \"accept\"} ok' "
         "WHEN 2 THEN '\"score\": '||cast(doc_id % 13 AS {S}) WHEN 3 THEN 'I give '||cast(doc_id % 10 AS {S})||' / 10' WHEN 4 THEN '```json'||chr(10)||'{\"score\": 7}'||chr(10)||'```' ELSE 'nothing' END")  # fmt: skip


@query("parse_judge_json", "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN doc_id % 10 + 0.5 WHEN 1 THEN doc_id % 10 WHEN 2 THEN least(10, doc_id % 13) WHEN 3 THEN doc_id % 10 WHEN 4 THEN 7 ELSE 5 END::DOUBLE AS score, CASE doc_id % 6 WHEN 0 THEN 'fallback' WHEN 1 THEN 'accept' WHEN 2 THEN CASE WHEN doc_id % 13 >= 8 THEN 'accept' ELSE 'patch' END WHEN 3 THEN CASE WHEN doc_id % 10 >= 8 THEN 'accept' ELSE 'patch' END ELSE 'patch' END AS action FROM documents")
def parse_judge_json(spark, d):
    return table(spark, d, "documents").select("doc_id", J.parse_verdict(F.expr(_JSON.replace("{S}", "string"))).alias("v")).select("doc_id", "v.score", "v.action")


# ---- words as sets and rows ----


def _word_rows(spark, d):
    s = table(spark, d, "documents").select("doc_id", F.explode(T.word_set(F.col("text"))).alias("word"))
    b = table(spark, d, "benchmark").select(F.explode(T.word_set(F.col("text"))).alias("word")).distinct()
    return s, b


_WR = f"s AS (SELECT doc_id, unnest({words_sql('text')}) AS word FROM documents), b AS (SELECT DISTINCT unnest({words_sql('text')}) AS word FROM benchmark)"


@query("word_overlap_semi", f"WITH {_WR} SELECT doc_id, count(*) AS n FROM s WHERE word IN (SELECT word FROM b) GROUP BY doc_id")
def word_overlap_semi(spark, d):
    s, b = _word_rows(spark, d)
    return s.join(b, "word", "left_semi").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("word_overlap_anti", f"WITH {_WR} SELECT doc_id, count(*) AS n FROM s WHERE word NOT IN (SELECT word FROM b) GROUP BY doc_id")
def word_overlap_anti(spark, d):
    s, b = _word_rows(spark, d)
    return s.join(b, "word", "left_anti").groupBy("doc_id").agg(F.count("*").alias("n"))


def _two_sets(f):
    def run(spark, d):
        both = markdown(spark, d).select("doc_id", T.word_set(F.col("text")).alias("s"), T.word_set(F.left(F.col("m"), F.lit(400))).alias("w"))
        return both.select("doc_id", F.array_join(F.array_sort(f("s", "w")), " ").alias("words"))

    return run


_SETS = f"WITH {MD}, k AS (SELECT doc_id, {words_sql('text')} AS s, {words_sql('left(m, 400)')} AS w FROM md) SELECT doc_id, array_to_string(list_sort(@), ' ') AS words FROM k"
query("set_intersect_words", _SETS.replace("@", "list_intersect(s, w)"))(_two_sets(F.array_intersect))
query("set_except_words", _SETS.replace("@", "list_filter(s, lambda x: NOT list_contains(w, x))"))(_two_sets(F.array_except))
