"""Text and line operators, case by case."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.operators import judge as J
from quillmill.operators import lines as L
from quillmill.operators import profile as P


def run(spark, f, texts, schema="string"):
    """f over a column of texts, in order."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i int, t {schema}")
    return [r.r for r in df.select("i", f(F.col("t")).alias("r")).orderBy("i").collect()]


def run_df(spark, f, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.t for r in f(df).orderBy("i").collect()]


SCALAR = {
    T.strip_html_comments: [("a <!-- x --> b", "a  b"), ("<!-- page 3 -->\nt", "<!-- page 3 -->\nt"), ("<!-- a\nb -->z", "z"), ("<!--PAGE 12-->", "<!--PAGE 12-->"), ("<!-- page x -->", ""), ("none", "none"), (None, None)],
    T.clean_latex: [("$\\mathbb定{R}$", "$\\mathbb{R}$"), ("$$\n\\sqrt{b定}\n$$", "$$\n\\sqrt{b}\n$$"), ("定 kept", "定 kept"), ("$a定\nb$", "$a定\nb$"), ("", "")],
    T.strip_think: [("<think>a\nb</think>c", "c"), ("x /think y\nz", "x \nz"), ("docs/think about it", "docs"), ("<THINK>q</THINK>", "")],
    T.strip_think_reply: [("a /think \nb", "a\nb"), ("see /think more", "see /think more"), (" <think>x</think> k ", "k")],
    T.normalize_ws: [("a\n\n\n\n\nb", "a\n\nb"), ("a  \nb\t", "a\nb"), ("\n a \n", "a")],
    T.clean_ocr: [("treat-\nment", "treatment"), ("a line\n12\nmore", "a line\nmore"), ("text\nx\nmore", "text\nmore"), ("12345\nabc", "12345\nabc"), ("one\n\n\n\n\ntwo", "one\n\ntwo")],
    T.normalize_ligatures: [("ﬁﬂﬀﬃﬄ", "fifffffiffl"[:2] + "fl" + "ff" + "ffi" + "ffl"), ("‘a’ “b” – —", "'a' \"b\" - -")],
    T.clean_artifacts: [("a\n.\n.\n.\nb", "a\n\nb"), ("x\n.\ny", "x\n\ny"), ("<math a>\\mathsf{Digitized} by</math>k", "k"), ("a\n\n\n\n\nb", "a\n\nb")],
    T.unwrap_fences: [("```markdown\n# a\n```", "# a"), ("```python\nx\n```", "```python\nx\n```")],
    T.strip_hallucination: [("It seems that", ""), ("I cannot see it", ""), ("Here is a cleaned version", ""), ("The heart", "The heart"), (" this appears to be a partial", "")],
    T.math_delims: [(r"\(a\) \[b\]", "$a$ $$\nb\n$$")],
    T.extract_code: [("see ICD-10, I50", "ICD-10"), ("ICD 10 I50", "ICD 10 I50"), ("icd11-BA00.Z x", "icd11-BA00.Z"), ("nothing", "Unknown")],
    T.parse_review_score: [("Score: 7.5 / 10", 7.5), ("Score: 8/10", 8.0), ("no", None)],
    T.is_garbled: [("/g1a /gff /g0b a b c", True), ("/g1a /gff /g0b a", False), ("a b c d /g12", False), ("", False)],
    T.needs_format: [("```", True), ("a /think", True), ("## a\n#### b", True), ("## a\n\n## b\n\n## c", True), ("## a\n### b", False), ("plain", False)],
    T.abbreviations_only: [("BP: Blood pressure\n\nECG: Echo", True), ("BP: Blood\nplain", False), ("", False)],
    T.is_section_header: [("DIAGNOSIS AND TESTS", True), ("TREATMENT:", True), ("• ITEM", False), ("1. FIRST", False), ("CAD", False), ("CAD, LVH", False), ("ASPIRIN 325 MG/DAY", False), ("Mixed case words", False), ("MULTIDISCIPLINARY CARE", False), ("REFERENCES", False), ("A B C D E F G H I J", False), ("", False)],
    T.word_set: [("The THE cat, value123 ab", ["the", "cat"]), ("café naïve text", ["text"]), ("", []), ("snake_case word", ["word"])],
    J.structure_score: [("## A\n\n|---|---|\n", 10.0), ("plain", 8.0), ("page 1 of 2 page 2 of 2", 6.0), ("x" * 501, 7.0), ("", 8.0), ("```\n" * 5, 6.5), ("# Visual Content\n## Text Transcription", 8.0)],
}


@pytest.mark.parametrize("f", SCALAR, ids=lambda f: f.__name__)
def test_scalar(spark, f):
    assert run(spark, f, [a for a, _ in SCALAR[f]]) == [b for _, b in SCALAR[f]]


S = ["GATE 2024\na\nGATE 2024\nb\nGATE 2024", "Page 1 of 9\nx\npage 2 of 9", "gate 2024\nGATE 2024", "\n\na", "IIT Delhi\nIIT Delhi x", ""]


def test_exam_headers(spark):
    assert run_df(spark, lambda d: L.strip_exam_headers(d, "t"), S) == ["GATE 2024\na\nb", "x", "gate 2024\nGATE 2024", "\n\na", "IIT Delhi\nIIT Delhi x", ""]


def test_dedup_lines(spark):
    assert run_df(spark, lambda d: L.dedup_lines(d, "t"), ["a\na\nb", "a\nb\na", "a\n\na", "\n\n\n", "a\na\na", "a\na "]) == ["a\nb", "a\nb\na", "a\n\na", "\n\n\n", "a", "a\na "]


def test_dedup_sections(spark):
    got = run_df(spark, lambda d: L.dedup_sections(d, "t", ["i"]), ["## A\nshort\n## B\nb\n## A\nmuch longer body", "pre\n## A\nx\n## a\ny", "no heading", "## A\nsame\n## A\nsize", "##\nx", "# A\n1\n## A\n2"])
    assert got == ["## A\nmuch longer body\n## B\nb", "pre\n## A\nx", "no heading", "## A\nsame", "##\nx", "# A\n1\n## A\n2"]


def test_validate_tables(spark):
    bad = "  <!-- col mismatch: expected 2 got 1 -->"
    got = run_df(spark, lambda d: L.validate_tables(d, "t", ["i"]), ["| a | b |\n|---|---|\n| c |", "| a |\n| b |", "| a |\ntext\n|---|---|\n| c | d |", "| a | b |\n|---|---|\n| c | d |", "| x |\n| y |\n| z |\n| u |\n|--|--|\n| k |"])
    assert got == ["| a | b |\n|---|---|\n| c |" + bad, "| a |\n| b |", f"| a |{bad}\ntext\n|---|---|\n| c | d |", "| a | b |\n|---|---|\n| c | d |", f"| x |\n| y |{bad}\n| z |{bad}\n| u |{bad}\n|--|--|\n| k |{bad}"]


def test_references_and_sections(spark):
    text = "intro\nREFERENCES\n1. Smith 2020\n\nhttps://x\nback\n2. kept\nMULTIDISCIPLINARY CARE\nREFERENCES\n3. Gone"
    assert run_df(spark, lambda d: L.skip_references(d, "t", ["i"]), [text, "REFERENCES"]) == ["intro\nback\n2. kept", ""]
    doc = "lead\nBP: Blood pressure\nFIRST PART\na\n\nSECOND PART:\nb\nFIRST PART\nc\nEMPTY PART"
    df = spark.createDataFrame([(1, doc)], "i int, t string")
    got = [(r.name, r.body) for r in L.split_sections(df, "t", ["i"]).orderBy("ord").collect()]
    assert got == [("OVERVIEW", "lead"), ("FIRST PART", "c"), ("SECOND PART", "b"), ("ABBREVIATIONS", "BP: Blood pressure")]


def test_patch_section(spark):
    md = "# T\n## One\nold\n## Two\nkeep"
    df = spark.createDataFrame([(0, md, "one", "n\\1$w"), (1, md, "Three", "n"), (2, "## Two", "Two", "n")], "i int, t string, h string, c string")
    got = [r.r for r in df.select("i", T.patch_section(F.col("t"), F.col("h"), F.col("c")).alias("r")).orderBy("i").collect()]
    assert got == ["# T\n## One\nn\\1$w\n\n## Two\nkeep", md + "\n\n## Three\n\nn", "## Two\n\n## Two\n\nn"]


def test_whole_chain_and_its_properties(spark):
    every = "<!-- page 1 -->\n## A\nx\nx\n<!-- gone -->GATE 2024\nPage 1 of 2\nGATE 2024\n| a | b |\n|---|---|\n| c |\n<think>t</think>\n## A\ny\n\n\n\n\n$é$ /think no"
    (got,) = run_df(spark, lambda d: L.postprocess(d, "t", ["i"]), [every])
    assert "gone" not in got and got.count("GATE") == 1 and "Page 1" not in got and "col mismatch: expected 2 got 1" in got and "<!-- page 1 -->" in got
    assert "think" not in got and "é" not in got and "\n\n\n" not in got and got.count("## A") == 1


@given(st.lists(st.text(alphabet="a \n|-#$/<>!\tk1", max_size=60), min_size=30, max_size=30))
@settings(max_examples=4, deadline=None)
def test_idempotent(spark, texts):
    once = run_df(spark, lambda d: L.dedup_lines(d, "t"), texts)
    assert run_df(spark, lambda d: L.dedup_lines(d, "t"), once) == once
    once = run(spark, T.normalize_ws, texts)
    assert run(spark, T.normalize_ws, once) == once


def test_exam_marks(spark):
    texts = ["GATE 2023 paper", "JEE (Advanced) 2020", "ESE 2024", "Q.1 Solve", "Maximum Marks: 100", "PART A - 20 Marks", "UPSC ESE", "A research paper", "The court held that part a"]
    df = spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], "d int, p int, text string")
    got = {r.d: r.exam for r in P.detect_exam(df, "d", "p").collect()}
    assert [got[i] for i in range(9)] == [True] * 7 + [False] * 2


def test_page_types_at_their_bounds(spark):
    rows = [(99, 0.41, 0), (99, 0.4, 0), (100, 0.41, 0), (499, 0.51, 0), (500, 0.51, 0), (499, 0.5, 0), (800, 0.1, 2), (800, 0.2, 1), (800, 0.21, 1), (100, 0.3, 0), (99, 0.3, 0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, n int, r double, t int")
    got = [r.k for r in df.select("i", P.page_type(F.col("n"), F.col("r"), F.col("t")).alias("k")).orderBy("i").collect()]
    assert got == ["scanned", "text_rich", "mixed", "image_heavy", "mixed", "mixed", "table_heavy", "text_rich", "mixed", "mixed", "text_rich"]


@pytest.mark.parametrize("n,tier", [(1, "small"), (49, "small"), (50, "medium"), (199, "medium"), (200, "large"), (499, "large"), (500, "huge")])
def test_size_tiers(spark, n, tier):
    assert spark.range(1).select(P.size_tier(F.lit(n)).alias("t")).first().t == tier


def test_heuristic_scores(spark):
    rows = [(0, "alpha beta gamma", "## H\nalpha beta gamma"), (1, "alpha beta gamma delta", "alpha"), (2, "alpha beta", "alpha beta " + " ".join(f"made{'x' * i}" for i in range(6))), (3, "", "anything here")]
    df = spark.createDataFrame(rows, "i int, text string, md string")
    got = {r.i: r for r in J.heuristic(df).collect()}
    assert got[0].content_score == 10.0 and got[0].action == "accept" and got[0].confidence == "High"
    assert got[1].content_score == 2.5 and got[1].action == "fallback"
    assert got[2].hallucination_rate == pytest.approx(6 / 8) and got[2].content_score == pytest.approx(7.0) and "L2: high hallucination rate 75% — 6 words not in source" in got[2].gaps
    assert got[3].content_score == 5.0 and got[3].hallucination_rate == 0.0


def test_a_score_at_a_half_is_rounded_as_sql_does(spark):
    """0.7 * 7.5 + 0.3 * 9 is 7.949999999999999 as a double."""
    df = spark.createDataFrame([("alpha beta gamma delta", "## H\nalpha beta gamma")], "text string, md string")
    (row,) = J.heuristic(df).collect()
    assert (row.content_score, row.structure_score, row.score, row.action, row.confidence) == (7.5, 9.0, 8.0, "accept", "High")
    assert [spark.range(1).select(T.rounded(F.lit(x), 1)).first()[0] for x in (7.949999999999999, 7.94, 0.05, 10.0)] == [8.0, 7.9, 0.1, 10.0]


def test_layout_coverage(spark):
    el = spark.createDataFrame([(0, 0, "table"), (0, 1, "text"), (1, 0, "table"), (1, 1, "picture"), (2, 0, "furniture")], "k int, ord int, label string")
    md = spark.createDataFrame([(0, "|---|---|\n and some text of length"), (1, "nothing of the kind here"), (2, "x"), (3, "y")], "k int, md string")
    got = {r.k: r for r in J.layout_coverage(el, md, ["k"]).collect()}
    assert got[0].coverage == 1.0 and got[0].layout_gaps == [] and got[2].coverage == 1.0 and got[3].coverage == 1.0
    assert got[1].coverage == 0.0 and got[1].layout_gaps == ["L1: table expected 1, found ~0", "L1: picture expected 1, found ~0"]


def test_verdicts(spark):
    cases = [('{"score": 7.5, "action": "accept"}', 7.5, "accept"), ('ok {"score": 3} so', 3.0, "patch"), ('```json\n{"score": 9}\n```', 9.0, "patch"), ('"score": 44', 10.0, "accept"), ("I say 6/10", 6.0, "patch"), ("no idea", 5.0, "patch"), (None, 5.0, "patch")]
    got = run(spark, J.parse_verdict, [c[0] for c in cases])
    assert [(r.score, r.action) for r in got] == [(s, a) for _, s, a in cases]


def test_disclaimer_block(spark):
    block = "This STW has been prepared by national experts of India\nwith feasibility in mind.\nKindly visit our web portal for more (stw.icmr.org.in) of 2022\n"
    df = spark.createDataFrame([("Dose 5 mg\n" + block + "Rest\nThis STW has been prepared by hand",), ("This STW has been prepared by national experts\nkept",)], "t string")
    got = [r.t for r in df.select(T.strip_boilerplate(F.col("t")).alias("t")).collect()]
    assert got == ["Dose 5 mg\nRest\nThis STW has been prepared by hand", "This STW has been prepared by national experts\nkept"]
