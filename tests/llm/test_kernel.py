"""The byte kernels against plain Python."""

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmill.llm import boosting as B
from quillmill.llm import bytekernel as K
from quillmill.llm import docstats as D

WORD = re.compile(r"(?:[a-z0-9]|[^\x00-\x7f])+")


@given(st.lists(st.one_of(st.none(), st.text(max_size=40)), max_size=8))
@settings(max_examples=150, deadline=None)
def test_words_and_hashes(texts):
    got = []
    for s in K.slices(pa.array(texts, pa.string()), 50):
        w = K.words(s)
        for i in range(s.n):
            got.append([K.word_hash(s.low[a:b].tobytes().decode()) == h for a, b, h in zip(w.start[w.off[i] : w.off[i + 1]], w.end[w.off[i] : w.off[i + 1]], w.hash[w.off[i] : w.off[i + 1]])])
        x = D.structure(s, w)
        assert x.shape == (s.n, len(D.NAMES)) and np.isfinite(x).all()
    low = [pa.compute.utf8_lower(pa.scalar(t or "")).as_py() for t in texts]
    assert [len(g) for g in got] == [len(WORD.findall(t)) for t in low]
    assert all(all(g) for g in got)


def test_slices_do_not_change_results():
    texts = pa.array(["one two three", None, "", "four five " * 30, "six"] * 7)
    whole = np.concatenate([D.structure(s, K.words(s)) for s in K.slices(texts, 1 << 20)])
    parts = np.concatenate([D.structure(s, K.words(s)) for s in K.slices(texts, 20)])
    assert np.allclose(whole, parts)


def test_statistics():
    (s,) = K.slices(pa.array(["The THE the end!!\nsame line\nsame line"]))
    x = dict(zip(D.NAMES, D.structure(s, K.words(s))[0]))
    assert x["echoes"] == pytest.approx(2 / 8) and x["top_word"] == pytest.approx(3 / 8) and x["distinct_words"] == pytest.approx(4 / 8)
    assert x["repeated_lines"] == pytest.approx(1 / 3) and x["bangs"] == pytest.approx(2 / 8) and x["capital_words"] == pytest.approx(1 / 8)


def test_trees_learn_and_keep_signs():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 5)).astype(np.float32)
    y = (x[:, 0] - x[:, 1] + 0.5 * rng.normal(size=4000) > 0).astype(float)
    t = B.fit(x[:3000], y[:3000], trees=40, depth=3, signs=np.array([1, -1, 0, 1, 0]))
    assert ((t.margin(x[3000:]) > 0) == y[3000:]).mean() > 0.85
    for f, sign in ((0, 1), (1, -1), (3, 1)):
        lo, hi = x[:500].copy(), x[:500].copy()
        hi[:, f] += rng.uniform(0, 3, 500).astype(np.float32)
        assert (sign * (t.margin(hi) - t.margin(lo)) >= -1e-12).all()


def test_flat_arrays_equal_walking_the_nodes():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 4, size=(300, 3)).astype(np.float32)
    t = B.fit(x, (x.sum(1) > 4).astype(float), trees=10, depth=3)

    def walk(row):
        total = t.bias
        for i in t.roots:
            while t.left[i] != i:
                i = t.left[i] if row[t.feature[i]] <= t.threshold[i] else t.right[i]
            total += t.value[i]
        return total

    assert np.allclose(t.margin(x), [walk(r) for r in x])


@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 1)), min_size=1, max_size=30))
@settings(max_examples=100, deadline=None)
def test_isotonic(pairs):
    s, y = np.array([float(a) for a, _ in pairs]), np.array([float(b) for _, b in pairs])
    p = B.step(*B.isotonic(s, y), s)
    assert (np.diff(p[np.argsort(s, kind="stable")]) >= -1e-12).all()
    assert p.mean() == pytest.approx(y.mean())
    brute = min(((np.interp(s, [0, 6], [a, b]) - y) ** 2).sum() for a in np.linspace(0, 1, 5) for b in np.linspace(0, 1, 5) if b >= a)
    assert ((p - y) ** 2).sum() <= brute + 1e-9
