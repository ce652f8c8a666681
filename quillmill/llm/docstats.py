"""Statistics of whole documents, vectorised over a slice; shared by the trained models."""

from __future__ import annotations

import numpy as np

from quillmill.llm.bytekernel import _U, DIGIT, HIGH, LOWER, PROSE, SPACE, SYMBOL, UPPER, Slice, Words, grams, row_sums, runs, span_hash

NAMES = (
    "log_words", "mean_word", "std_word", "long_words", "short_words", "symbols", "symbols_per_word", "capitals", "capital_words", "digits", "spaces", "prose_marks",
    "bangs", "pipes", "distinct_words", "top_word", "echoes", "distinct_trigrams", "repeated_lines", "log_line", "line_ends", "non_ascii",
)
#: Of these, more can only lower a document's quality.
LOWERS = ("symbols", "symbols_per_word", "capitals", "capital_words", "bangs", "pipes", "echoes", "top_word", "repeated_lines", "long_words")

_BANG, _PIPE, _STOP = (np.isin(np.arange(256), list(x)) for x in (b"!", b"|", b".!?:"))


def _most(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes and the count of the commonest, for each row."""
    both = np.sort((doc.astype(np.uint64) << _U(40)) | (h >> _U(24)))
    if not len(both):
        return np.zeros(n), np.zeros(n)
    at = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
    count, row = np.diff(np.r_[at, len(both)]), (both[at] >> _U(40)).astype(np.int64)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, row, count)
    return np.bincount(row, minlength=n).astype(float), top.astype(float)


def structure(s: Slice, w: Words) -> np.ndarray:
    """(rows, NAMES) float32; finite for every text, also empty ones."""
    share = lambda lut: row_sums(lut[s.raw], s.raw_off)
    chars = np.maximum(np.diff(s.raw_off), 1)
    n_words = np.diff(w.off).astype(float)
    per = np.maximum(n_words, 1)
    length = (w.end - w.start).astype(float)
    mean = row_sums(length, w.off) / per
    std = np.sqrt(np.maximum(row_sums(length**2, w.off) / per - mean**2, 0))
    upper, lower = share(UPPER), share(LOWER)
    symbols = share(SYMBOL)
    raw_start, raw_end = runs((UPPER | LOWER | DIGIT | HIGH)[s.raw], s.raw_off)
    raw_word_off = np.searchsorted(raw_start, s.raw_off)
    ups = np.r_[0, np.cumsum(UPPER[s.raw])]
    shouted = (ups[raw_end] - ups[raw_start] >= 2).astype(np.int64)
    distinct, top = _most(w.doc, w.hash, s.n)
    again = np.zeros(len(w.hash), np.int64)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    h, doc = grams(w, 3)
    distinct3, _ = _most(doc, h, s.n)
    line_start, line_end = runs(s.raw != 10, s.raw_off)
    line_off = np.searchsorted(line_start, s.raw_off)
    n_lines = np.maximum(np.diff(line_off), 1).astype(float)
    line_doc = np.repeat(np.arange(s.n), np.diff(line_off))
    distinct_lines, _ = _most(line_doc, span_hash(s.raw, line_start, line_end), s.n)
    ended = _STOP[s.raw[line_end - 1]].astype(np.int64) if len(line_end) else np.zeros(0, np.int64)
    n_grams = np.maximum(np.bincount(doc, minlength=s.n), 1)
    some = n_words > 0
    return np.column_stack([
        np.log1p(n_words), mean, std, row_sums((length > 20).astype(np.int64), w.off) / per, row_sums((length <= 3).astype(np.int64), w.off) / per,
        symbols / chars, symbols / per, upper / np.maximum(upper + lower, 1), row_sums(shouted, raw_word_off) / per, share(DIGIT) / chars, share(SPACE) / chars, share(PROSE) / per,
        share(_BANG) / per, share(_PIPE) / per, np.where(some, distinct / per, 1), top / per, row_sums(again, w.off) / per, np.where(some, distinct3 / n_grams, 1),
        np.where(np.diff(line_off) > 0, 1 - distinct_lines / n_lines, 0), np.log1p(chars / n_lines), row_sums(ended, line_off) / n_lines, share(HIGH) / chars,
    ]).astype(np.float32)
