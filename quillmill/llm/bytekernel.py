"""Vectorised text kernels: whole Arrow batches of UTF-8 as numpy byte arrays.

A word is a run of ASCII letters, digits or bytes of non-ASCII characters. Nulls count as
empty texts. A batch is worked off in slices of whole texts of about SLICE bytes, so memory
doesn't follow the batch; a longer text is a slice of its own, never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 19
_R, _U = np.uint64(0x9E3779B97F4A7C15), np.uint64
_R_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _class(*ranges: tuple[int, int] | str) -> np.ndarray:
    lut = np.zeros(256, bool)
    for r in ranges:
        if isinstance(r, str):
            lut[list(r.encode())] = True
        else:
            lut[r[0] : r[1] + 1] = True
    return lut


UPPER, LOWER, DIGIT, SPACE, HIGH = _class((65, 90)), _class((97, 122)), _class((48, 57)), _class(" \t\n\r\f\v"), _class((128, 255))
WORD = UPPER | LOWER | DIGIT | HIGH
PROSE = _class(".,;:'\"-()?")
SYMBOL = ~(WORD | SPACE | PROSE)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@dataclass
class Words:
    """start, end: byte positions; hash: of the lower-cased word; doc: row; off: first word of each row, and the end."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    doc: np.ndarray
    off: np.ndarray


@dataclass
class Slice:
    """first: row of the batch; raw and low: bytes as they are and lower-cased, each with row offsets."""

    first: int
    n: int
    raw: np.ndarray
    raw_off: np.ndarray
    low: np.ndarray
    low_off: np.ndarray


def _bytes(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = a.buffers()[2]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(a) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def slices(text: pa.Array | pa.ChunkedArray, size: int = SLICE) -> Iterator[Slice]:
    text = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
    text = pc.fill_null(text.cast(pa.large_string()), "")
    at = np.cumsum(np.asarray(pc.binary_length(text), np.int64))
    first = 0
    while first < len(text):
        base = at[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(at, base + size, "right")))
        part = text.slice(first, last - first)
        raw, raw_off = _bytes(part)
        low, low_off = _bytes(pc.utf8_lower(part))
        yield Slice(first, last - first, raw, raw_off, low, low_off)
        first = last


def runs(member: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes; no run crosses a row."""
    edge = np.zeros(len(member) + 1, bool)
    edge[off] = True
    before, after = np.empty_like(member), np.empty_like(member)
    before[:1], before[1:] = False, member[:-1]
    after[-1:], after[:-1] = False, member[1:]
    return np.flatnonzero(member & (edge[:-1] | ~before)), np.flatnonzero(member & (edge[1:] | ~after)) + 1


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte spans: differences of prefix sums of a polynomial modulo 2^64."""
    if not len(start):
        return np.zeros(0, np.uint64)
    power = np.full(len(data) + 1, _R, np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + _U(1)) * power[:-1], out=total[1:])
    inverse = np.full(len(data) + 1, _R_INV, np.uint64)
    inverse[0] = 1
    np.multiply.accumulate(inverse, out=inverse)
    return mix((total[end] - total[start]) * inverse[start])


def words(s: Slice) -> Words:
    start, end = runs(WORD[s.low], s.low_off)
    off = np.searchsorted(start, s.low_off)
    return Words(start, end, span_hash(s.low, start, end), np.repeat(np.arange(s.n), np.diff(off)), off)


def word_hash(word: str) -> int:
    """The hash that words() gives this word."""
    b = np.frombuffer(word.lower().encode(), np.uint8)
    return int(span_hash(b, np.array([0]), np.array([len(b)]))[0])


def grams(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each run of k words; a row of fewer words has one gram of all of them."""
    n, count = len(w.hash), np.diff(w.off)
    at = np.flatnonzero(np.arange(n) - w.off[w.doc] <= np.maximum(count[w.doc] - k, 0))
    h = np.zeros(len(at), np.uint64)
    for i in range(k):
        inside = at + i < w.off[w.doc[at] + 1]
        h = mix(h * _U(0xD6E8FEB86659FD93) + np.where(inside, w.hash[np.minimum(at + i, max(n - 1, 0))], _U(0)) + _U(i + 1))
    return h, w.doc[at]


def row_sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums between offsets, also of empty rows."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[off[1:]] - total[off[:-1]]
