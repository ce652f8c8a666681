"""HTML extraction: the cut against brute force, accuracy against the pages' own markup, odd markup."""

import itertools
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmill.llm import html_cut as H

WEIGHT = st.sampled_from([0.25, 0.5, 1.0, 2.0])


@given(st.lists(st.sampled_from([-3.0, -1.0, -0.5, 0.0, 0.5, 1.0, 3.0]), min_size=1, max_size=7), st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6), WEIGHT), max_size=12))
@settings(max_examples=250, deadline=None)
def test_cut_is_least(gain, edges):
    edges = [(i, j, w) for i, j, w in edges if i < len(gain) and j < len(gain)]

    def cost(side):
        return sum(max(g, 0) for g, s in zip(gain, side) if not s) + sum(max(-g, 0) for g, s in zip(gain, side) if s) + sum(w for i, j, w in edges if side[i] != side[j])

    best = min(cost(s) for s in itertools.product([False, True], repeat=len(gain)))
    got = H.min_cut(gain, edges)
    assert cost(got) == pytest.approx(best)
    least = [s for s in itertools.product([False, True], repeat=len(gain)) if cost(s) == pytest.approx(best)]
    assert [all(s[i] for s in least) for i in range(len(gain))] == got  # the least of the minimum cuts


def want(page):
    body = re.search(r"<article>(.*)</article>", page, re.S).group(1)
    return [t for t in (" ".join(H._html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br|b)>", body)) if t]


def test_whole_query_finds_the_articles(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r.page_id: r for r in H.query(spark, sf).collect()}
    assert pages.keys() == got.keys()
    hit = sum(got[i].text.split("\n") == want(p) for i, p in pages.items())
    assert hit >= 0.98 * len(pages)


def test_pages_without_html5_elements(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    weights = H.train(pages)
    plain = pages.withColumn("html", F.regexp_replace("html", "<(/?)(?:nav|article|footer)", "<$1div"))
    got = {r.page_id: r.text.split("\n") for r in H.extract(plain, weights).collect()}
    pairs = [(set(got[r.page_id]), set(want(r.html))) for r in pages.collect()]
    assert np.mean([len(a & b) / max(len(a | b), 1) for a, b in pairs]) > 0.95


@pytest.mark.parametrize("page,texts", [
    ("<p>a<p>b", ["a", "b"]), ("<!-- <p>x", []), ("<script>var a='<p>x</p>'</script><p>y", ["y"]), ("a &amp; b<br>c", ["a & b", "c"]), ("<div><b>x</div>y</b> z", ["x", "y z"]),
    ("<p title='a>b'>t</p>", ["t"]), ("no tags at all", ["no tags at all"]), ("<", ["<"]), ("<p", ["<p"]), ("</p></div>x", ["x"]), ("<title>t</title>", ["t"]), ("<head><title>t</title></head>x", ["x"]),
])
def test_blocks(page, texts):
    assert [b.text for b in H.blocks(page)] == texts


@pytest.mark.parametrize("page,texts", [
    ("<head><title>t</title><meta x><p>a", ["a"]), ("<head><title>t</title><body>a", ["a"]), ("<head>\n<link x>a<br>b", ["a", "b"]), ("<head><title>t</title>odd</head>x", ["x"]),
    ("<head><noscript><p>j</p></noscript><title>t</title></head>x", ["x"]), ("<head><script>'</head><p>'</script><title>t</title></head>x", ["x"]), ("<head><title>t<p>a", ["t", "a"]),
    ("<svg w='1' /><p>a", ["a"]), ("<svg><svg/><text>i</text></svg><p>a", ["a"]), ("<svg><p>a</p><svg><text>i</text></svg>", ["a"]), ("<noscript><p>a", ["a"]), ("<template><p>a", ["a"]),
    ("<template><template>x</template>y</template>a", ["a"]), ("<style-guide>a</style-guide>", ["a"]), ("a<style>b", ["a"]), ("a<script>b", ["a"]), ("<head><p>a</p><head><p>b", ["a", "b"]),
])
def test_only_what_is_hidden_goes(page, texts):
    assert [b.text for b in H.blocks(page)] == texts


@given(st.text(alphabet="<>/pdivnaul!-'\"= &;x\n", max_size=80))
@settings(max_examples=300, deadline=None)
def test_any_markup_is_read(page):
    bs = H.blocks(page)
    on = H.label(bs, H.features(bs) @ np.ones(H.N_FEATURES)) if bs else []
    assert len(on) == len(bs)


def test_cases(spark):
    rows = [(1, None), (2, ""), (3, "<p>" + "word " * 50_000), (4, "<ul>" + "<li><a href=x>k</a>" * 3000 + "</ul><p>" + "This is a long enough sentence, to be content. " * 5), (5, "<p>same</p>"), (5, "<p>same</p>"), (None, "<p>null id, but a text of some length here.</p>")]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumns({"text": F.lit("mine"), "n_blocks": F.lit(0), "url": F.lit(None).cast("string")})
    got = H.extract(df, H.train(df)).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == 7 and by[1].text is None and by[1].n_blocks == 0 and by[2].text == ""
    assert len(by[3].text) > 200_000 and "long enough" in by[4].text and by[4].n_content < 10
    assert len({(r.text, r.n_blocks) for r in got if r.page_id == 5}) == 1
    assert H.extract(df.limit(0), H.train(df.limit(0))).count() == 0


MB = 1 << 20
HARD = {
    "nested": "<div>x" * (MB // 6), "unended tags": "<a " * (MB // 3), "unended quotes": "<a \"<b '" * (MB // 8), "declarations": "<!x" * (MB // 3), "scripts": "<script " * (MB // 8), "heads": "<head " * (MB // 6),
    "unmatched ends": "<div>" * (MB // 10) + "</p>" * (MB // 8), "inline ends": "<b><div>" + "<i>" * (MB // 6) + "</b>" * (MB // 8), "attributes": "<a " + "class=" * (MB // 6) + ">",
    "ambiguous": "".join(f"<p>{'word ' * (3 + i % 9)}{'.' * (i % 3)}<div><b>y{i}</b>, z</div>" for i in range(MB // 70)), "paragraphs": "<p>x" * (MB // 4),
}


@pytest.mark.parametrize("name", HARD)
def test_a_megabyte_of_hard_markup(name):
    """In time and memory in proportion to the page."""
    import resource
    import time

    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.process_time()
    bs = H.blocks(HARD[name])
    on = H.label(bs, H.features(bs) @ np.random.default_rng(0).normal(size=H.N_FEATURES)) if bs else []
    assert len(on) == len(bs) and time.process_time() - began < 20  # under 7 s here
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500 * 1024


@pytest.mark.parametrize("kind", ["chain", "triangles"])
def test_a_large_ambiguous_graph_is_cut(kind):
    """As a chain has it by dynamic programming over two sides; triangles by the condition that no single flip pays."""
    rng = np.random.default_rng(4)
    n = 20_000
    gain = rng.normal(0, 1, n)
    edges = [(i, i + 1, 1.0) for i in range(n - 1)] + ([(i, i + 2, 0.6) for i in range(0, n - 2, 2)] if kind == "triangles" else [])
    side = np.array(H.min_cut(gain.tolist(), edges))
    cost = np.maximum(gain, 0)[~side].sum() + np.maximum(-gain, 0)[side].sum() + sum(w for i, j, w in edges if side[i] != side[j])
    arc = {j: (i, w) for i, j, w in edges if j == i + 2}
    state = {(a, b): (max(-gain[0], 0) if a else max(gain[0], 0)) + (max(-gain[1], 0) if b else max(gain[1], 0)) + (a != b) for a in (0, 1) for b in (0, 1)}
    for i in range(2, n):
        w = arc[i][1] if i in arc else 0.0
        state = {(b, c): min(state[a, b] + w * (a != c) for a in (0, 1)) + (b != c) + (max(-gain[i], 0) if c else max(gain[i], 0)) for b in (0, 1) for c in (0, 1)}
    assert cost == pytest.approx(min(state.values()))
