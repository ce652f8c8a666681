"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks of text at block-level tags. A logistic model gives each block the
cost of calling it content or boilerplate: its capacities to the two terminals. Neighbouring
blocks, and blocks that follow each other under the same parent element, are tied by edges that
weaken with their distance in the DOM: the cost of separating them. The minimum cut, found by
max-flow, is the labelling of least total cost.

The model is trained here, on blocks of at most TRAIN_PAGES pages whose authors told content
from boilerplate by HTML5 elements (article and main; nav, header, footer, aside, ...). Those
elements aren't among its features, so it carries over to pages without them; where a page has
them, or tell-tale class names, they are evidence of a fixed weight beside the model's.
"""

from __future__ import annotations

import html as _html
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.boosting import sigmoid
from quillmill.llm.common import bound_batches, least_hashed, table

TRAIN_PAGES = 2_000
EVIDENCE, ADJACENT, SIBLING = 3.0, 0.8, 0.6

_DROP = re.compile(r"<!--|<[!?]|<(script|style)(?=[\s/>])", re.I)
_SHUT = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style")}
_HIDDEN = re.compile(r"<(/?)(noscript|template|svg)(?=[\s/>])((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>", re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)")
_STOP = re.compile(r"[>\"']")
_ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*[\"']?([^\"'>]*)", re.I)
_HINT = re.compile(r"\b(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|copyright|footer|header|login|menu|nav\w*|newsletter|pagination|popup|promo\w*|related|search|share|sidebar|social|sponsor\w*|subscribe|tags?|widget)\b", re.I)
_BLOCK = frozenset("address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
#: A head's opening and the elements that only a head has; what ends a head whose content goes on.
_HEAD = re.compile(r"<head(?=[\s/>])[^>]*>(?:\s|<(?:meta|link|base)(?=[\s/>])[^>]*>|<title(?=[\s/>])[^>]*>[^<]*</title\s*>)*", re.I)
_HEAD_END = re.compile(rf"(</head\s*>)|<(?:{'|'.join(sorted(_BLOCK - {'title', 'html'}))})(?=[\s/>])", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_GOOD, _BAD = frozenset(("article", "main")), frozenset("nav header footer aside menu form".split())
_KINDS = (("p", "blockquote", "pre"), ("li", "dt", "dd"), ("h1", "h2", "h3", "h4", "h5", "h6"), ("td", "th"), ("div", "section", "body"))
_KIND = {t: i for i, ts in enumerate(_KINDS) for t in ts}
_CLOSES = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
N_FEATURES = 8 + len(_KINDS)


class Block:
    """text, (words, tag of its kind), words in links, depth: of open block elements, shared: how many of these the block before has too,
    parent: number of the last but one, 0 for none, side: +1 in a content element, -1 in boilerplate, hint."""

    __slots__ = ("depth", "hint", "links", "parent", "shared", "side", "text", "words")

    def __init__(self, text: str, tag: str, links: int, depth: int, shared: int, parent: int, side: int, hint: bool) -> None:
        self.text, self.links, self.depth, self.shared, self.parent, self.side, self.hint = text, links, depth, shared, parent, side, hint
        self.words = (len(text.split()), tag)


def _without(page: str, spans: list[tuple[int, int]]) -> str:
    """page with a space for each span; spans may overlap."""
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += (page[at:a], " ")
        at = max(at, b)
    return "".join((*out, page[at:]))


def _dropped(page: str) -> str:
    """page with a space for each comment, declaration, script and style. Each is found once, from its start to its end."""
    out, kept, at, last = [], 0, 0, page.rfind(">")
    while m := _DROP.search(page, at):
        if m.group() == "<!--":
            end = page.find("-->", m.end())
            end = len(page) if end < 0 else end + 3
        elif m.end() > last:
            at = m.end()
            continue
        else:
            end = page.find(">", m.end()) + 1
            if m.group(1):
                shut = _SHUT[m.group(1).lower()].search(page, end)
                end = shut.end() if shut else len(page)
        out += (page[kept : m.start()], " ")
        kept = at = end
    out.append(page[kept:])
    return "".join(out)


def tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """start, end, whether it closes, name, attributes of each tag. An end sign in quotes doesn't end a tag; what has no end is text.

    A quote that an unended tag opened is remembered, and so is the next quote or end sign, so the page is gone through a constant few times.
    """
    dead: set[int] = set()
    none: dict[str, int] = {}
    at = ahead = 0  # ahead: the first quote or end sign from where it was last looked for
    looked = -1
    while m := _TAG.search(page, at):
        i, way, end = m.end(), [], -1
        while True:
            if not looked <= i <= ahead:
                found = _STOP.search(page, i)
                looked, ahead = i, found.start() if found else len(page)
            if ahead == len(page):
                break
            if page[ahead] == ">":
                end = ahead + 1
                break
            quote = page[ahead]
            if ahead in dead:
                break
            way.append(ahead)
            close = -1 if none.get(quote, len(page)) <= ahead else page.find(quote, ahead + 1)
            if close < 0:
                none[quote] = min(none.get(quote, len(page)), ahead)
                break
            i = close + 1
        if end < 0:
            dead.update(way)
            if not way and ahead == len(page):
                return  # no end sign is left
            at = m.end()
            continue
        yield m.start(), end, bool(m.group(1)), m.group(2).lower(), page[m.end() : end - 1]
        at = end


def visible(page: str) -> str:
    """page without comments, scripts and styles, which run to the end if unclosed, and without hidden elements and the head.

    A noscript, template or svg without its end tag, or an svg closed in its own tag, hides nothing. A head
    ends at its end tag if that comes before the body or a block element, else after the elements that only a
    head has.
    """
    page = _dropped(page)
    spans: list[tuple[int, int]] = []
    opened: dict[str, list[int]] = {"noscript": [], "template": [], "svg": []}
    for m in _HIDDEN.finditer(page):
        tag = m.group(2).lower()
        if not m.group(1):
            if tag != "svg" or not m.group(3).endswith("/"):
                opened[tag].append(m.start())
        elif opened[tag]:
            spans.append((opened[tag].pop(), m.end()))
    if spans:
        page = _without(page, spans)
    spans, end = [], None
    for m in _HEAD.finditer(page, 0, page.rfind(">") + 1):
        if not spans or end and end.start() < m.end():
            end = _HEAD_END.search(page, m.end())
        spans.append((m.start(), end.end() if end and end.group(1) else m.end()))
    return _without(page, spans) if spans else page


def blocks(page: str) -> list[Block]:
    """The page's blocks of text in order, whatever the markup, in time in proportion to its length."""
    page = visible(page)
    out: list[Block] = []
    # Open elements: tag, and of it and those around it: side, tag of a kind, hint.
    stack: list[tuple[str, int, str, bool]] = []
    block_at: list[int] = []  # places in the stack of block elements
    numbers = [0]  # theirs, after one for the page
    places: dict[str, list[int]] = {}
    parts: list[str] = []
    links = at = number = shared = 0
    in_link = False

    def flush() -> None:
        nonlocal links, shared
        text = " ".join(_html.unescape("".join(parts)).split()) if parts else ""
        if text:
            _, side, tag, hint = stack[-1] if stack else ("", 0, "div", False)
            depth = len(block_at)
            out.append(Block(text, tag, links, depth, min(shared, depth), numbers[-2] if depth > 1 else 0, side, hint))
            shared = depth
        parts.clear()
        links = 0

    def shut(to: int) -> None:
        nonlocal shared
        while len(stack) > to:
            places[stack.pop()[0]].pop()
        while block_at and block_at[-1] >= to:
            block_at.pop()
            numbers.pop()
        shared = min(shared, len(block_at))

    for start, end, closing, tag, attrs in tags(page):
        if start > at:
            piece = page[at:start]
            parts.append(piece)
            if in_link:
                links += len(piece.split())
        at = end
        inner = block_at[-1] if block_at else -1
        if tag in _BLOCK:
            flush()
        if closing:
            if tag == "a":
                in_link = False
            # An inline end tag closes nothing outside its block.
            if places.get(tag) and (tag in _BLOCK or places[tag][-1] > inner):
                shut(places[tag][-1])
        elif tag not in _VOID and not attrs.rstrip().endswith("/"):
            if tag in _CLOSES and inner >= 0 and stack[inner][0] in _CLOSES[tag]:
                shut(inner)
            if tag in _BLOCK:
                shut(block_at[-1] + 1 if block_at else 0)  # inline elements left open don't reach into the next block
                block_at.append(len(stack))
                number += 1
                numbers.append(number)
            _, side, kind, hint = stack[-1] if stack else ("", 0, "div", False)
            side = 1 if tag in _GOOD else -1 if tag in _BAD else side
            places.setdefault(tag, []).append(len(stack))
            stack.append((tag, side, tag if tag in _KIND else kind, hint or bool(attrs) and any(_HINT.search(a) for a in _ATTR.findall(attrs))))
            if tag == "a":
                in_link = True
    parts.append(page[at:])
    flush()
    return out


def features(bs: list[Block]) -> np.ndarray:
    n = len(bs)
    x = np.zeros((n, N_FEATURES))
    for i, b in enumerate(bs):
        w, tag = b.words
        t = b.text
        x[i, :8] = 1, np.log1p(w), b.links / max(w, 1), len(t) / max(w, 1) / 10, t[-1] in ".!?:;\"'”»", (t.count(",") + t.count(".")) / max(w, 1), "©" in t or "|" in t, i / n
        x[i, 8 + _KIND[tag] if tag in _KIND else 12] = 1
    return x


def ties(bs: list[Block]) -> list[tuple[int, int, float]]:
    """Edges (i, j, weight) of neighbours and of blocks next to each other under one parent."""
    out: list[tuple[int, int, float]] = []
    last: dict[int, int] = {}
    for i, b in enumerate(bs):
        if i:
            out.append((i - 1, i, ADJACENT / (1 + max(b.depth + bs[i - 1].depth - 2 * b.shared - 1, 0))))
        if b.parent in last:
            out.append((last[b.parent], i, SIBLING))
        last[b.parent] = i
    return out


_EPS = 1e-12


def min_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The source side of the least minimum cut: node i costs gain[i] on the sink side if positive, -gain[i] on the
    source side if negative, and an edge its weight if cut.

    A node whose gain outweighs all its edges is on its terminal's side of the least minimum cut;
    those are settled first, over and over. A node of one edge then sends what flow it has or wants through it: if the edge
    carries that, the node is on its neighbour's side, else on its own. Max-flow by blocking flows does the rest, for
    each connected component by itself.
    """
    n = len(gain)
    gain = list(gain)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        if i != j and w > 0:
            near[i][j] = near[i].get(j, 0.0) + w
            near[j][i] = near[j].get(i, 0.0) + w
    side: list[bool | None] = [None] * n
    tied = [sum(d.values()) for d in near]
    follows: list[tuple[int, int]] = []
    gone = [False] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if gone[i]:
            continue
        if gain[i] > tied[i] + _EPS or -gain[i] >= tied[i] - _EPS:
            side[i] = gain[i] > 0
            for j, w in near[i].items():
                gain[j] += w if side[i] else -w
        elif len(near[i]) == 1:
            (j,) = near[i]
            gain[j] += gain[i]
            follows.append((i, j))
        else:
            continue
        gone[i] = True
        for j, w in near[i].items():
            del near[j][i]
            tied[j] = sum(near[j].values()) if len(near[j]) < 4 else tied[j] - w
            todo.append(j)
    for start in range(n):
        if gone[start]:
            continue
        part, queue = [start], deque([start])
        gone[start] = True
        while queue:
            for j in near[queue.popleft()]:
                if not gone[j]:
                    gone[j] = True
                    part.append(j)
                    queue.append(j)
        up = _flow(part, gain, near)
        for i in part:
            side[i] = i in up
    for i, j in reversed(follows):
        side[i] = side[j]
    return [bool(x) for x in side]


def _flow(part: list[int], gain: list[float], near: list[dict[int, float]]) -> set[int]:
    """The nodes of a component that the source still reaches after a maximum flow."""
    source, sink = [i for i in part if gain[i] > 0], [i for i in part if gain[i] < 0]
    if not source or not sink:
        return set(source and part if not sink and sum(gain[i] for i in source) > _EPS else ())
    give, want = {i: gain[i] for i in source}, {i: -gain[i] for i in sink}
    cap = {i: dict(near[i]) for i in part}
    while True:
        # Levels from the nodes that have flow left; a phase goes no deeper than the nearest that want some.
        level = dict.fromkeys((i for i in source if give[i] > _EPS), 0)
        edge, reached = list(level), False
        while edge and not reached:
            after = []
            for u in edge:
                if want.get(u, 0.0) > _EPS:
                    reached = True
                for v, c in cap[u].items():
                    if c > _EPS and v not in level:
                        level[v] = level[u] + 1
                        after.append(v)
            edge = after
        if not reached:
            return set(level)
        left = {u: iter(list(cap[u])) for u in level}
        for s in [i for i in source if give[i] > _EPS]:
            path = [s]
            while path:
                u = path[-1]
                if want.get(u, 0.0) > _EPS:
                    flow = min([give[s], want[u], *(cap[a][b] for a, b in zip(path, path[1:], strict=False))])
                    give[s] -= flow
                    want[u] -= flow
                    keep = len(path)
                    for k, (a, b) in enumerate(zip(path, path[1:], strict=False)):
                        cap[a][b] -= flow
                        cap[b][a] += flow
                        if cap[a][b] <= _EPS:
                            keep = min(keep, k + 1)
                    if give[s] <= _EPS:
                        break
                    # On from before the first edge that is full; an end that has enough may lead on.
                    del path[keep:]
                    if keep < len(path) + 1 and path:
                        left[path[-1]] = iter(list(cap[path[-1]]))
                    continue
                for v in left[u]:
                    if cap[u][v] > _EPS and level.get(v, -1) == level[u] + 1:
                        path.append(v)
                        break
                else:
                    path.pop()


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.1, steps: int = 25) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (p - y) + l2 * w)
    return w


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for page in b.column("html").to_pylist():
            bs = blocks(page)
            if bs:
                x = features(bs)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(bs) + 1, dtype=np.int32) * N_FEATURES), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([c.side for c in bs], pa.int32()), lists], ["side", "x"])


def train(pages: DataFrame, rows: int = TRAIN_PAGES) -> np.ndarray:
    """Weights of the features. Without blocks of both kinds: long blocks of few links are content."""
    sample = least_hashed(bound_batches(pages).where("html is not null").select("html"), rows, pages.count(), 41, "html")
    got = sample.mapInArrow(_samples, "side int, x array<double>").where("side <> 0").toArrow()
    side = got.column("side").to_numpy()
    default = np.zeros(N_FEATURES)
    default[:3] = -2.5, 1.0, -4.0
    if len(side) == 0 or side.min() == side.max():
        return default
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(len(side), -1)
    order = np.lexsort(np.vstack([x.T, side]))
    return logistic(x[order], (side[order] > 0).astype(float))


def label(bs: list[Block], margin: np.ndarray) -> list[bool]:
    gain = [max(-8.0, min(8.0, float(m))) + EVIDENCE * b.side - EVIDENCE * (b.hint and b.side <= 0) for b, m in zip(bs, margin, strict=True)]
    return min_cut(gain, ties(bs))


def extract(pages: DataFrame, weights: np.ndarray) -> DataFrame:
    """page_id, text, n_blocks, n_content for each row of pages (page_id, html, ...).

    text: the content blocks of the whole page, a line each. Defined results: a null page has a null
    text and no blocks; an empty page, or one without content, an empty text; broken markup is
    read as far as it goes (an unclosed comment, script or style runs to the end, nothing else does); repeated rows get
    equal results; an empty table gives an empty result; other columns play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts, total, kept = [], [], []
                for page in part.column("html").to_pylist():
                    bs = blocks(page) if page else []
                    on = label(bs, features(bs) @ weights) if bs else []
                    texts.append(None if page is None else "\n".join(c.text for c, keep in zip(bs, on, strict=True) if keep))
                    total.append(len(bs))
                    kept.append(sum(on))
                yield pa.RecordBatch.from_arrays([part.column("page_id"), pa.array(texts, pa.string()), pa.array(total, pa.int32()), pa.array(kept, pa.int32())], ["page_id", "text", "n_blocks", "n_content"])

    rows = bound_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), "html")
    return rows.mapInArrow(run, "page_id long, text string, n_blocks int, n_content int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, train(pages))
