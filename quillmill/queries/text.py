"""Queries over single texts and their lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.operators import lines as L
from quillmill.queries.base import MD, markdown, query, strip_sql, table

_RX = lambda x, p, r="", f="g": f"regexp_replace({x}, '{p}', '{r}', '{f}')"


def _scalar(name: str, column, sql: str, source: str = "m") -> None:
    @query(name, f"WITH {MD} SELECT doc_id, {sql} AS result FROM md")
    def run(spark, d):
        return markdown(spark, d).select("doc_id", column(F.col(source)).alias("result"))


_THREE, _FOUR = ((f"\\n{{{n},}}", "\n\n") for n in (3, 4))
_COMMENTS = "replace(replace(" + _RX(_RX("m", r"<!--(\s*page\s+\d+\s*)-->", "\x01\\1\x02", "gi"), r"<!--(?:.*?)-->", "", "gs") + ", '\x01', '<!--'), '\x02', '-->')"


def _clean_sql(x: str, p: str) -> str:
    return f"array_to_string(list_transform(list_zip(string_split_regex({x}, '{p}'), regexp_extract_all({x}, '{p}')), lambda z: z[1] || coalesce(regexp_replace(z[2], '[^\\x00-\\x7F]', '', 'g'), '')), '')"


def latex_sql(x: str) -> str:
    return _clean_sql(_clean_sql(x, r"(?s)\$\$.*?\$\$"), r"\$[^$\n]{1,300}\$")


_THINK = _RX(_RX("m", "<think>.*?</think>", "", "gis"), r"(?m)/think\b.*$")


def ws_sql(x: str) -> str:
    return strip_sql(_RX(_RX(x, r"(?m)[ \t]+$"), *_THREE))


_scalar("strip_html_comments", T.strip_html_comments, _COMMENTS)
_scalar("clean_latex", T.clean_latex, latex_sql("m"))
_scalar("strip_think", T.strip_think, _THINK)
_scalar("strip_think_reply", T.strip_think_reply, strip_sql(_RX(_RX("m", "<think>.*?</think>", "", "gis"), r"(?m)\s*/think\s*$")))
_scalar("normalize_ws", T.normalize_ws, ws_sql("m"))
_OCR = r"(select string_agg(l, chr(10) order by i) from (select unnest(ls) as l, generate_subscripts(ls, 1) as i from (select string_split(regexp_replace(m, '([\p{L}\p{N}_])-\n([\p{L}\p{N}_])', '\1\2', 'g'), chr(10)) as ls)) where not (regexp_full_match(" + strip_sql("l") + r", '\d{1,4}') or length(" + strip_sql("l") + ") in (1, 2)))"
_scalar("clean_ocr", T.clean_ocr, strip_sql(_RX(_OCR, *_THREE)))
_LIG = """translate(replace(replace(replace(replace(replace(m, 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), '‘’“”–—', '''''""--')"""
_scalar("normalize_ligatures", T.normalize_ligatures, _LIG)
#: Markdown behind a publisher's lines. The SQL has literals of its own, so a pattern that departs shows.
_PUBLISHED = (
    "'Department of Health Research'||NL||'STANDARD TREATMENT WORKFLOW (STW) for '||lang||NL||'May 2022 https://a.b/c'||NL||CASE WHEN doc_id % 3 = 0 THEN 'This STW has been prepared by national experts of '||lang||NL||'with feasibility'"
    "||NL||'visit our web portal (stw.icmr.org.in) for more'||NL ELSE 'stw.icmr.org.in https://d.e'||NL END||'3. 4. Smith J, a paper'||NL||'5. Jones K. Some title. Lancet 2020'||NL||'6. Plain item kept'||NL||'7. http://x.y'||NL"
    "||'© Indian Council of Medical Research 2022'||NL||'Kindly visit our web portal now'||NL||'Ministry of Health and Family Welfare Government of India'||NL||'ﬁne “quotes”'||NL||m"
).replace("NL", "chr(10)")
_BOIL = _LIG.replace("(m,", f"({_PUBLISHED},")
for _p in (
    r"Department of Health Research\s*", r"Ministry of Health and Family Welfare,?\s*Government of India\s*", r"Standard Treatment Work[0-9a-z_]*\s*[(]STW[)][^\n]*\n?",
    r"(January|February|March|April|May|June|July|August|September|October|November|December)[/ ]+[0-9]{4}\s*", r"This STW has been prepared by national experts.*?web portal[^\n]*[(]stw[.]icmr[.]org[.]in[)][^\n]*\n?",
    r"© Indian Council of Medical Research[^\n]*\n?", r"Kindly visit our web portal[^\n]*\n?", r"stw[.]icmr[.]org[.]in\s*", r"^\s*[0-9]+[.]\s+[0-9]+[.]\s+[a-z]{2,}[^\n]+\n?",
    r"^\s*[0-9]+[.]\s+[a-z]{2,}[^\n]+(doi|ncbi|pubmed|uptodate[.]com|Am Fam|J Am|European|Lancet)[^\n]*\n?", r"^\s*[0-9]+[.]\s+https?:[/]{2}[^\n]+\n?", r"^\s*https?:[/]{2}[^\n]+\n?",
):
    _BOIL = f"regexp_replace({_BOIL}, '(?ims){_p}', '', 'g')"


@query("strip_boilerplate", f"WITH {MD} SELECT doc_id, {_BOIL} AS result FROM md")
def strip_boilerplate(spark, d):
    return markdown(spark, d).select("doc_id", T.strip_boilerplate(F.expr(_PUBLISHED)).alias("result"))


_scalar("clean_artifacts", T.clean_artifacts, _RX(_RX(_RX(_RX("m", r"(?:\n\.){3,}", "\n"), r"(?m)^\.$"), "(?is)<math(?:[^>]*)>(?:.*?)Digitized(?:.*?)</math>"), *_FOUR))
_FENCED = "'```markdown'||chr(10)||m||chr(10)||'```'||chr(10)||text"


@query("unwrap_fences", f"WITH {MD} SELECT doc_id, {strip_sql(_RX('(' + _FENCED + ')', r'(?s)`{3}markdown\s*\n(.*?)\n`{3}', chr(92) + '1'))} AS result FROM md")
def unwrap_fences(spark, d):
    return markdown(spark, d).select("doc_id", T.unwrap_fences(F.expr(_FENCED)).alias("result"))


_REPLY = "CASE WHEN doc_id % 3 = 0 THEN 'It seems ' WHEN doc_id % 3 = 1 THEN 'Below is a cleaned ' ELSE '' END||text"


@query("strip_hallucination", f"SELECT doc_id, CASE WHEN regexp_matches({strip_sql('(' + _REPLY + ')')}, '{T.META_OPENER.replace(chr(39), chr(39) * 2)}') THEN '' ELSE {_REPLY} END AS result FROM documents")
def strip_hallucination(spark, d):
    return table(spark, d, "documents").select("doc_id", T.strip_hallucination(F.expr(_REPLY)).alias("result"))


_MATH = "'a '||chr(92)||'('||lang||chr(92)||') b '||chr(92)||'['||text||chr(92)||'] c'"


@query("math_delims", f"SELECT doc_id, replace(replace(replace(replace({_MATH}, chr(92)||'(', '$'), chr(92)||')', '$'), chr(92)||'[', '$$'||chr(10)), chr(92)||']', chr(10)||'$$') AS result FROM documents")
def math_delims(spark, d):
    return table(spark, d, "documents").select("doc_id", T.math_delims(F.expr(_MATH)).alias("result"))


_GARBLED = "CASE WHEN doc_id % 2 = 0 THEN '/g1a /gff /G0b2 word '||left(text, 20) ELSE text END"


@query("is_garbled", f"SELECT doc_id, len(t) >= 5 AND len(list_filter(t, lambda x: regexp_matches(x, '(?i)^/g[0-9a-f]{{2,4}}'))) * 4 > len(t) AS result FROM (SELECT doc_id, list_filter(string_split_regex({_GARBLED}, '\\s+'), lambda x: x <> '') AS t FROM documents)")
def is_garbled(spark, d):
    return table(spark, d, "documents").select("doc_id", T.is_garbled(F.expr(_GARBLED)).alias("result"))


_FORMAT = "CASE doc_id % 5 WHEN 0 THEN '## A'||chr(10)||'#### B c' WHEN 1 THEN '## A'||chr(10)||chr(10)||'## B'||chr(10)||chr(10)||'## C' WHEN 2 THEN '```' WHEN 3 THEN 'a /think' ELSE '' END||chr(10)||text"


@query("needs_format", f"SELECT doc_id, contains(x, '```') OR contains(x, '/think') OR contains(x, '<think>') OR regexp_matches(x, '(?m)^#{{2}}[^#].*\\n+#{{4}}[^#]') OR regexp_matches(x, '(?m)^## \\w+(?:\\n\\n## \\w+){{2}}') AS result FROM (SELECT doc_id, {_FORMAT} AS x FROM documents)")
def needs_format(spark, d):
    return table(spark, d, "documents").select("doc_id", T.needs_format(F.expr(_FORMAT)).alias("result"))


@query("content_loss_ok", "SELECT doc_id, length(text) = 0 OR length(left(text, 800)) >= length(text) * 0.65::DOUBLE AS result FROM documents")
def content_loss_ok(spark, d):
    return table(spark, d, "documents").select("doc_id", T.content_loss_ok(F.col("text"), F.expr("left(text, 800)")).alias("result"))


_CODED = "CASE doc_id % 3 WHEN 0 THEN 'see ICD-10-I50.9 ' WHEN 1 THEN 'icd 11 BA00 ' ELSE '' END||text"


@query("extract_code", f"SELECT doc_id, coalesce(nullif(regexp_extract({_CODED}, '(?i)(ICD[\\s-]?(?:1[01])?[\\s-]?[.\\w]+)', 1), ''), 'Unknown') AS result FROM documents")
def extract_code(spark, d):
    return table(spark, d, "documents").select("doc_id", T.extract_code(F.expr(_CODED)).alias("result"))


_REVIEW = "'Review. Score: '||cast(doc_id % 11 as {S})||'.5 / 10 '||left(text, 30)"


@query("parse_review_score", f"SELECT doc_id, try_cast(regexp_extract({_REVIEW.format(S='varchar')}, 'Score:\\s*([0-9]+(?:[.][0-9]+)?)\\s*/\\s*10', 1) AS DOUBLE) AS result FROM documents")
def parse_review_score(spark, d):
    return table(spark, d, "documents").select("doc_id", T.parse_review_score(F.expr(_REVIEW.format(S="string"))).alias("result"))


def words_sql(x: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-z]{{3,}}')))"


@query("word_set", f"SELECT doc_id, len(w) AS n_words, array_to_string(list_sort(w), ' ') AS words FROM (SELECT doc_id, {words_sql('text')} AS w FROM documents)")
def word_set(spark, d):
    w = table(spark, d, "documents").select("doc_id", T.word_set(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n_words"), F.array_join(F.array_sort("w"), " ").alias("words"))


_LINES = "l AS (SELECT doc_id, i - 1 AS pos, ls[i] AS line FROM (SELECT doc_id, ls, unnest(generate_series(1, len(ls))) AS i FROM (SELECT doc_id, string_split(m, chr(10)) AS ls FROM md)))"
_AGG = "string_agg(line, chr(10) ORDER BY pos)"


@query("dedup_lines", f"WITH {MD}, {_LINES}, k AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM l) SELECT doc_id, {_AGG} AS result FROM k WHERE {strip_sql('line')} = '' OR prev IS NULL OR line <> prev GROUP BY doc_id")
def dedup_lines(spark, d):
    return L.dedup_lines(markdown(spark, d).select("doc_id", F.col("m").alias("result")), "result")


_HEADER = r"(?i)^(GATE\s+[0-9]{4}|ESE\s+[0-9]{4}|IES\s+[0-9]{4}|JEE\s*(Main|Advanced)?|[NI]IT\s+\w+|IISc(\s+Bengaluru)?|Electrical\s+Engineering\s*[(]?EE[0-9]*[)]?|Computer\s+Science\s*[(]?CS[0-9]*[)]?|Organizing\s+Institute\s*:.*)\s*$"
_PAGE = r"(?i)^page\s+[0-9]+\s+of\s+[0-9]+\s*$"
_EXAM_SQL = f"SELECT doc_id, {_AGG} AS result FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, s ORDER BY pos) AS nth FROM (SELECT *, {strip_sql('line')} AS s FROM l)) WHERE NOT regexp_matches(s, '{_PAGE}') AND (NOT regexp_matches(s, '{_HEADER}') OR nth = 1) GROUP BY doc_id"


@query("strip_exam_headers", f"WITH {MD}, {_LINES} {_EXAM_SQL}")
def strip_exam_headers(spark, d):
    return L.strip_exam_headers(markdown(spark, d).select("doc_id", F.col("m").alias("result")), "result")


def _sections_sql(src: str) -> str:
    """CTE body: doc_id, m of src with sections deduplicated."""
    return f"""(WITH l AS (SELECT doc_id, i - 1 AS pos, ls[i] AS line FROM (SELECT doc_id, ls, unnest(generate_series(1, len(ls))) AS i FROM (SELECT doc_id, string_split(m, chr(10)) AS ls FROM {src}))),
 b AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^#{{1,4}}\\s+\\S') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS block FROM l),
 h AS (SELECT doc_id, block, string_agg(line, chr(10) ORDER BY pos) AS body, CASE WHEN block > 0 THEN lower({strip_sql('arg_min(line, pos)')}) ELSE '' END AS head,
   sum(length({strip_sql('line')})) - CASE WHEN block > 0 THEN length({strip_sql('arg_min(line, pos)')}) ELSE 0 END AS size FROM b GROUP BY doc_id, block),
 r AS (SELECT *, min(block) OVER (PARTITION BY doc_id, head) AS place, row_number() OVER (PARTITION BY doc_id, head ORDER BY size DESC, block) AS nth FROM h)
 SELECT doc_id, string_agg(body, chr(10) ORDER BY place) AS m FROM r WHERE nth = 1 GROUP BY doc_id)"""


def _tables_sql(src: str) -> str:
    return f"""(WITH l AS (SELECT doc_id, i - 1 AS pos, ls[i] AS line FROM (SELECT doc_id, ls, unnest(generate_series(1, len(ls))) AS i FROM (SELECT doc_id, string_split(m, chr(10)) AS ls FROM {src}))),
 t AS (SELECT *, regexp_matches({strip_sql('line')}, '^\\|.+\\|$') AS r, regexp_matches({strip_sql('line')}, '^\\|[\\s|:\\-]+\\|$') AS s, length(line) - length(replace(line, '|', '')) - 1 AS c FROM l),
 a AS (SELECT *, lead(CASE WHEN s THEN c END, 1) OVER w AS a1, lead(CASE WHEN s THEN c END, 2) OVER w AS a2, lead(CASE WHEN s THEN c END, 3) OVER w AS a3, sum(CASE WHEN r THEN 0 ELSE 1 END) OVER w AS run FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
 e AS (SELECT *, min(CASE WHEN r AND coalesce(a1, a2, a3) IS NOT NULL THEN pos END) OVER (PARTITION BY doc_id, run) AS start FROM a),
 x AS (SELECT e.*, coalesce(f.a1, f.a2, f.a3) AS want FROM e LEFT JOIN e f ON e.doc_id = f.doc_id AND e.start = f.pos)
 SELECT doc_id, string_agg(line || CASE WHEN r AND pos >= start AND NOT s AND c <> want THEN '  <!-- col mismatch: expected ' || want || ' got ' || c || ' -->' ELSE '' END, chr(10) ORDER BY pos) AS m FROM x GROUP BY doc_id)"""


@query("dedup_sections", f"WITH {MD} SELECT doc_id, m AS result FROM {_sections_sql('md')}")
def dedup_sections(spark, d):
    return L.dedup_sections(markdown(spark, d).select("doc_id", F.col("m").alias("result")), "result", ["doc_id"])


@query("validate_tables", f"WITH {MD} SELECT doc_id, m AS result FROM {_tables_sql('md')}")
def validate_tables(spark, d):
    return L.validate_tables(markdown(spark, d).select("doc_id", F.col("m").alias("result")), "result", ["doc_id"])


_POST = f"""WITH {MD}, m1 AS (SELECT doc_id, {latex_sql('(' + _COMMENTS + ')')} AS m FROM md),
l AS (SELECT doc_id, i - 1 AS pos, ls[i] AS line FROM (SELECT doc_id, ls, unnest(generate_series(1, len(ls))) AS i FROM (SELECT doc_id, string_split(m, chr(10)) AS ls FROM m1))),
m2 AS (SELECT doc_id, result AS m FROM ({_EXAM_SQL})), m3 AS (SELECT doc_id, {_THINK} AS m FROM m2), m4 AS {_sections_sql('m3')},
l5 AS (SELECT doc_id, i - 1 AS pos, ls[i] AS line FROM (SELECT doc_id, ls, unnest(generate_series(1, len(ls))) AS i FROM (SELECT doc_id, string_split(m, chr(10)) AS ls FROM m4))),
m5 AS (SELECT doc_id, {_AGG} AS m FROM (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM l5) WHERE {strip_sql('line')} = '' OR prev IS NULL OR line <> prev GROUP BY doc_id),
m6 AS {_tables_sql('m5')} SELECT doc_id, {ws_sql('m')} AS result FROM m6"""


@query("postprocess_run", _POST)
def postprocess_run(spark, d):
    return L.postprocess(markdown(spark, d).select("doc_id", F.col("m").alias("result")), "result", ["doc_id"])


#: A page with references and capital headers.
_LEGACY = ("'BP: Blood pressure'||NL||'intro'||NL||'REFERENCES'||NL||'1. Smith A 2020'||NL||''||NL||'https://x.y'||NL||left(text, 40)||NL||'2. Later line'||NL||'LISTEN TO YOUR HEART'||NL||'DIAGNOSIS AND TESTS:'||NL||text||NL"
           "||'KEY TERMS LIST'||NL||'ECG: Electro gram'||NL||'DIAGNOSIS AND TESTS'||NL||'again '||lang||NL||'DOSE OF 500 MG/KG'||NL||'EMPTY HEADER LINE'").replace("NL", "chr(10)")  # fmt: skip
_LEGACY_MD = f"md AS (SELECT doc_id, {_LEGACY} AS m FROM documents)"
_IN = lambda xs: "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + ")"


@query("reference_skip", f"""WITH {_LEGACY_MD}, {_LINES}, c AS (SELECT *, s IN {_IN(T.SLOGANS)} AS slogan, s = 'REFERENCES' AS mark, s = '' OR regexp_matches(s, '^(?:\\d+\\.\\s+|https?://)') AS cited FROM (SELECT *, {strip_sql('line')} AS s FROM l)),
k AS (SELECT *, coalesce(max(CASE WHEN mark THEN pos END) OVER w, -1) AS lm, coalesce(max(CASE WHEN NOT slogan AND NOT mark AND NOT cited THEN pos END) OVER w, -1) AS lo FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, {strip_sql("string_agg(line, chr(10) ORDER BY pos)")} AS result FROM k WHERE NOT (slogan OR mark OR (cited AND lm > lo)) GROUP BY doc_id""")
def reference_skip(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.expr(_LEGACY).alias("result"))
    return L.skip_references(docs, "result", ["doc_id"])


def header_sql(x: str) -> str:
    s, b = strip_sql(x), "regexp_replace(" + strip_sql(x) + ", '[:* ]+$', '')"
    n = lambda p: f"len(regexp_extract_all({b}, '{p}'))"
    words = f"len(list_filter(string_split_regex({b}, '\\s+'), lambda q: q <> ''))"
    return (
        f"coalesce(length({s}) >= 4 AND NOT regexp_matches({s}, '^[•\\-*→·0-9(]') AND {s} NOT IN {_IN(T.SLOGANS + T.NO_HEADERS)} AND {n(r'\p{L}')} > 0 AND {n(r'\p{Lu}')} * 100 >= {n(r'\p{L}')} * 85 AND {words} <= 9"
        f" AND NOT ({words} = 1 AND length({b}) <= 6) AND NOT (contains({s}, ',') AND {words} <= 4) AND NOT ({n(r'\p{Nd}')} > 3 AND {n(r'\p{Nd}')} * 5 > length({b})) AND NOT regexp_matches({b}, '{T.DOSE}'), false)"
    )


@query("is_section_header", f"WITH {_LEGACY_MD}, {_LINES} SELECT doc_id, pos, {header_sql('line')} AS result FROM l")
def is_section_header(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(L.split_lines(F.expr(_LEGACY))).alias("pos", "line"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), T.is_section_header(F.col("line")).alias("result"))


_SPLIT = f"""WITH {_LEGACY_MD}, {_LINES}, s AS (SELECT doc_id, pos, {strip_sql('line')} AS s FROM l WHERE {strip_sql('line')} <> ''),
f AS (SELECT *, regexp_matches(s, '{T.ABBREVIATION}') AND length(s) < 55 AS short FROM s), g AS (SELECT *, NOT short AND {header_sql('s')} AS head FROM f),
b AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS block FROM g),
n AS (SELECT *, coalesce(max(CASE WHEN head THEN {strip_sql("regexp_replace(s, '[:* ]+$', '')")} END) OVER (PARTITION BY doc_id, block), 'OVERVIEW') AS name FROM b),
t AS (SELECT doc_id, block, name, string_agg(s, chr(10) ORDER BY pos) AS body FROM n WHERE NOT short AND NOT head GROUP BY ALL),
d AS (SELECT doc_id, name, min(block) AS place, arg_max(body, block) AS body FROM t GROUP BY ALL),
o AS (SELECT *, len(list_filter(string_split(body, chr(10)), lambda x: NOT regexp_matches(x, '{T.ABBREVIATION}'))) = 0 AS abbr FROM d),
m AS (SELECT doc_id, -1 AS place, pos, s FROM n WHERE short UNION ALL SELECT doc_id, place, i, ls[i] FROM (SELECT doc_id, place, ls, unnest(generate_series(1, len(ls))) AS i FROM (SELECT doc_id, place, string_split(body, chr(10)) AS ls FROM o WHERE abbr))),
u AS (SELECT doc_id, place, name, body FROM o WHERE NOT abbr UNION ALL SELECT doc_id, 1073741824, 'ABBREVIATIONS', string_agg(s, chr(10) ORDER BY place, pos) FROM m GROUP BY doc_id)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS ord, name, body FROM u"""


@query("split_sections", _SPLIT)
def split_sections(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.expr(_LEGACY).alias("m"))
    return L.split_sections(docs, "m", ["doc_id"]).select("doc_id", F.col("ord").cast("long").alias("ord"), "name", "body")


_ABBR = "CASE WHEN doc_id % 2 = 0 THEN 'BP: Blood'||chr(10)||chr(10)||' ECG: Echo ' ELSE 'BP: Blood'||chr(10)||text END"


@query("abbrev_body", f"SELECT doc_id, len(ls) > 0 AND len(list_filter(ls, lambda x: NOT regexp_matches(x, '{T.ABBREVIATION}'))) = 0 AS result FROM (SELECT doc_id, list_filter(list_transform(string_split({_ABBR}, chr(10)), lambda x: {strip_sql('x')}), lambda x: x <> '') AS ls FROM documents)")
def abbrev_body(spark, d):
    return table(spark, d, "documents").select("doc_id", T.abbreviations_only(F.expr(_ABBR)).alias("result"))


@query("heading_outline", f"WITH {MD} SELECT doc_id, array_to_string(list_transform(list_filter(string_split(m, chr(10)), lambda x: starts_with(x, '##'))[1:40], lambda x: {strip_sql(_RX('x', '^#+', '', ''))}), ' / ') AS outline FROM md".replace(", '', '')", ", '')"))
def heading_outline(spark, d):
    return markdown(spark, d).select("doc_id", F.array_join(L.heading_outline(F.col("m")), " / ").alias("outline"))


@query("patch_section", f"""WITH {MD}, p AS (SELECT doc_id, m, CASE WHEN doc_id % 2 = 0 THEN source ELSE 'Missing' END AS h, 'new '||lang AS c, list_filter(string_split_regex(chr(10)||m, '\\n## '), lambda x: true) AS ps FROM md),
q AS (SELECT *, list_transform(ps, lambda x, i: CASE WHEN i > 1 THEN chr(10)||'## ' ELSE '' END || CASE WHEN i > 1 AND contains(x, chr(10)) AND lower({strip_sql("split_part(x, chr(10), 1)")}) = lower(h) THEN split_part(x, chr(10), 1)||chr(10)||c||chr(10) ELSE x END) AS ns FROM p)
SELECT doc_id, CASE WHEN array_to_string(ns, '') <> chr(10)||m THEN substr(array_to_string(ns, ''), 2) ELSE m||chr(10)||chr(10)||'## '||h||chr(10)||chr(10)||c END AS result FROM q""")
def patch_section(spark, d):
    h = F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("Missing")
    return markdown(spark, d).select("doc_id", T.patch_section(F.col("m"), h, F.concat(F.lit("new "), "lang")).alias("result"))
