"""Main content of web pages: flat text blocks, classified by a decision tree.

The markup is read as a flat sequence of text blocks (what lies between two tags that are not
inline). Each block gets its words, its link density, the same of the blocks before and after it,
its kind of element and some shape of its text; a decision tree (CART, gini) fitted on the small
labelled table ``mainbody_labels.csv`` decides whether it is main content. Blocks are then matched
to the lines of the extracted text, in order, ignoring blanks and letter case. Lines without a
block, and pages without markup, are judged by a second tree that knows the text alone.

Defined results: blank lines are never main; null text gives no rows; null html falls back to the
text; rows of one page must be made one before; pages of any length are read whole.
"""

from __future__ import annotations

import csv
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

LABELS = Path(__file__).with_name("mainbody_labels.csv")
#: The bound of the labelled table the trees are fitted on.
MAX_LABELS = 20_000
_SPLIT = re.compile(r"(<!--.*?-->|<[^>]*>)", re.S)
_TAG = re.compile(r"<\s*(/?)\s*([a-zA-Z][a-zA-Z0-9]*)")
INLINE = frozenset("b i em strong u small sub sup code font mark abbr cite q".split())
BOX = frozenset("div article main nav aside header footer section form body table".split())
KINDS = ("h1", "h", "p", "li", "quote", "cell", "a", "button", "time", "span", "box", "code", "other")
_KIND = {"h1": "h1", **dict.fromkeys(("h2", "h3", "h4", "h5", "h6"), "h"), "p": "p", "li": "li", "blockquote": "quote", "td": "cell", "th": "cell", "tr": "cell", "a": "a", "button": "button", "time": "time", "span": "span", "script": "code", "style": "code", **dict.fromkeys(BOX, "box")}
FEATURES = (
    "words", "linked", "words_before", "linked_before", "words_after", "linked_after", "kind", "kind_before", "kind_after", "box_words", "home_box", "after_h1", "in_title",
    "names_site", "names_site_before", "sentence", "early_colon", "digits", "upper", "symbols", "from_end", "words_box_before",
)
TEXT_FEATURES = ("words", "words_before", "words_after", "is_title", "after_title", "names_site", "names_site_before", "names_site_after", "sentence", "sentence_before", "sentence_after", "early_colon", "digits", "upper", "symbols", "from_end", "braces", "run_before", "run_after", "next_long", "last_long")


def squeeze(s: str) -> str:
    return " ".join(s.lower().split())


def blocks(html: str) -> tuple[list[tuple[str, str, int, int]], str]:
    """(text, kind, linked characters, box) of each block, in order; and the page's title."""
    out: list[tuple[str, str, int, int]] = []
    stack: list[tuple[str, int]] = []
    boxes, box, link, tag, title = 0, 0, 0, "body", ""
    text: list[str] = []
    linked = 0
    in_title = False

    def flush() -> None:
        nonlocal linked
        if text:
            s = unescape("".join(text))
            if s.strip():
                kind = _KIND.get(tag, "other")
                home = box
                if kind == "box" and len(stack) > 1:  # text directly in a box belongs to the box around it
                    home = stack[-2][1]
                elif kind == "cell":  # and a cell's own text to the box around its table
                    at = max((i for i, x in enumerate(stack) if x[0] == "table"), default=0)
                    home = stack[at - 1][1] if at else box
                out.append((s, kind, linked, home))
            text.clear()
        linked = 0

    for part in _SPLIT.split(html):
        if not part:
            continue
        if part[0] == "<":
            m = _TAG.match(part)
            if not m:
                continue
            close, name = m[1], m[2].lower()
            if name in INLINE:
                continue
            if name == "title":
                in_title = not close
                continue
            flush()
            if name == "a":
                link = 0 if close else 1
            if close:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        del stack[i:]
                        break
            elif name not in ("meta", "br", "hr", "img", "link", "input") and not part.endswith("/>"):
                if name in BOX:
                    boxes += 1
                    stack.append((name, boxes))
                else:
                    stack.append((name, stack[-1][1] if stack else 0))
            tag, box = stack[-1] if stack else ("body", 0)
        elif in_title:
            title += unescape(part)
        else:
            text.append(part)
            if link:
                linked += len(part)
    flush()
    return out, title


def _shape(s: str, low: str, words: int, site: str) -> tuple:
    colon = s.lstrip().find(":")
    letters = sum(map(str.isalpha, s)) or 1
    return (
        float(bool(site) and site in low),
        float(s.rstrip()[-1:] in ".!?…”\"»"),
        float(0 < colon < 28),
        sum(map(str.isdigit, s)) / (len(s) or 1),
        sum(map(str.isupper, s)) / letters,
        float(sum(s.count(c) for c in "|©{};@")),
    )


def site_name(title: str) -> str:
    """What follows the last bar or dash of a page's title: the name of its site."""
    parts = re.split(r"\s[|–—-]\s", title)
    return squeeze(parts[-1]) if len(parts) > 1 else ""


def block_features(found: list[tuple[str, str, int, int]], title: str) -> np.ndarray:
    n = len(found)
    out = np.zeros((n, len(FEATURES)))
    if not n:
        return out
    site, head = site_name(title), squeeze(title)
    low = [squeeze(b[0]) for b in found]
    words = np.array([x.count(" ") + 1 for x in low], float)
    linked = np.array([min(1.0, b[2] / max(1, len(b[0]))) for b in found])
    kind = np.array([KINDS.index(b[1]) for b in found], float)
    box = np.array([b[3] for b in found])
    total = {b: words[(box == b) & (linked < 0.5)].sum() for b in set(box.tolist())}
    h1 = next((i for i, b in enumerate(found) if b[1] == "h1"), -1)
    best = found[h1][3] if h1 >= 0 else max(total, key=lambda b: (total[b], -b))  # the heading's box, else the wordiest
    shape = np.array([_shape(b[0], x, 0, site) for b, x in zip(found, low)])
    prev = lambda a, fill: np.concatenate([[fill], a[:-1]])
    after = lambda a, fill: np.concatenate([a[1:], [fill]])
    cols = (
        words, linked, prev(words, 0), prev(linked, 0), after(words, 0), after(linked, 0), kind, prev(kind, -1), after(kind, -1), np.array([total[b] for b in box]), (box == best).astype(float),
        (np.arange(n) - h1).clip(-3, 60) if h1 >= 0 else np.full(n, -9.0), np.array([float(len(x) > 3 and head.startswith(x)) for x in low]),
        shape[:, 0], prev(shape[:, 0], 0), shape[:, 1], shape[:, 2], shape[:, 3], shape[:, 4], shape[:, 5], (n - np.arange(n)).clip(0, 30), np.array([words[max(0, i - 3) : i].sum() for i in range(n)]),
    )
    return np.stack(cols, axis=1)


def text_features(lines: list[str], title: str | None, site: str) -> np.ndarray:
    """Features of the non-blank lines of a text without markup."""
    n = len(lines)
    if not n:
        return np.zeros((0, len(TEXT_FEATURES)))
    low = [squeeze(x) for x in lines]
    words = np.array([x.count(" ") + 1 for x in low], float)
    head = squeeze(title or "")
    is_title = np.array([float(bool(head) and (x == head or (len(x) > 8 and head.startswith(x)))) for x in low])
    at = int(is_title.argmax()) if is_title.any() else -1
    shape = np.array([_shape(a, x, 0, site) for a, x in zip(lines, low)])
    prev = lambda a: np.concatenate([[0.0], a[:-1]])
    after = lambda a: np.concatenate([a[1:], [0.0]])
    long = words >= 16
    last = int(np.flatnonzero(long).max()) if long.any() else -1
    index = np.arange(n)
    cols = (
        words, prev(words), after(words), is_title, (index - at).clip(-3, 60) if at >= 0 else np.full(n, -9.0), shape[:, 0], prev(shape[:, 0]), after(shape[:, 0]), shape[:, 1], prev(shape[:, 1]), after(shape[:, 1]), shape[:, 2], shape[:, 3], shape[:, 4], shape[:, 5],
        (n - index).clip(0, 30), np.array([float(x.count("{")) for x in lines]), np.array([words[max(0, i - 3) : i].sum() for i in index]), np.array([words[i + 1 : i + 4].sum() for i in index]), np.array([float(long[i + 1 :].sum()) for i in index]).clip(0, 5), (index - last).clip(-20, 20),
    )
    return np.stack(cols, axis=1)


class Tree:
    """A small CART: binary splits by gini impurity, leaves with the share of main blocks."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 9, least: int = 4):
        self.nodes: list[tuple[int, float, int, int, float]] = []
        self._grow(x, y.astype(float), depth, least)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, least: int) -> int:
        me = len(self.nodes)
        mean = y.mean() if len(y) else 0.0
        self.nodes.append((-1, 0.0, -1, -1, mean))
        if depth == 0 or len(y) < 2 * least or mean in (0.0, 1.0):
            return me
        best = (mean * (1 - mean) * len(y) - 1e-9, -1, 0.0)
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, s = x[order, f], y[order]
            ones, n = np.cumsum(s)[:-1], np.arange(1, len(s))
            ok = (v[1:] > v[:-1]) & (n >= least) & (len(s) - n >= least)
            if not ok.any():
                continue
            right, m = s.sum() - ones, len(s) - n
            cost = np.where(ok, ones * (1 - ones / n) + right * (1 - right / m), np.inf)
            k = int(cost.argmin())
            if cost[k] < best[0]:
                best = (cost[k], f, (v[k] + v[k + 1]) / 2)
        if best[1] < 0:
            return me
        left = x[:, best[1]] <= best[2]
        a = self._grow(x[left], y[left], depth - 1, least)
        b = self._grow(x[~left], y[~left], depth - 1, least)
        self.nodes[me] = (best[1], best[2], a, b, mean)
        return me

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            f, at, a, b, share = self.nodes[node]
            if f < 0:
                out[rows] = share
            elif len(rows):
                left = x[rows, f] <= at
                todo += [(a, rows[left]), (b, rows[~left])]
        return out


@lru_cache(maxsize=1)
def trees() -> tuple[Tree, Tree]:
    """The two trees, fitted on the labelled table: over blocks with markup, and over lines without."""
    rows: dict[str, list[list[float]]] = {"block": [], "line": []}
    with LABELS.open(newline="") as f:
        for i, r in enumerate(csv.reader(f)):
            if i >= MAX_LABELS:
                raise ValueError("the labelled table is larger than its bound")
            rows[r[0]].append([float(v) for v in r[1:]])
    a, b = np.array(rows["block"]), np.array(rows["line"])
    return Tree(a[:, 1:], a[:, 0]), Tree(b[:, 1:], b[:, 0])


def align(lines: list[str], texts: list[str]) -> list[int]:
    """For each line the block it came from, in order; -1 if there is none.

    A longest common subsequence over the whole page, so neither left-out blocks nor a line that
    turns up again far below cost other lines their blocks.
    """
    places: dict[str, list[int]] = {}
    for i, t in enumerate(texts):
        places.setdefault(t, []).append(i)
    ends: list[int] = []  # the least block at which a chain of each length ends
    last: list[tuple] = []  # that chain: (line, block, the chain before)
    for j, x in enumerate(lines):
        for i in reversed(places.get(x, ())):
            n = bisect_left(ends, i)
            link = (j, i, last[n - 1] if n else None)
            ends[n : n + 1] = [i]
            last[n : n + 1] = [link]
    out = [-1] * len(lines)
    link = last[-1] if last else None
    while link:
        out[link[0]] = link[1]
        link = link[2]
    return out


def main_lines(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id long, title string, text string, html string) to (page_id, line_no) of main lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_block, by_line = trees()
        for batch in batches:
            ids, numbers = [], []
            todo: list[tuple[int, int, int, str]] = []  # page, line, row of the features, which tree
            b_rows, l_rows, nb, nl = [], [], 0, 0
            for page, title, text, html in zip(*(c.to_pylist() for c in batch.columns)):
                numbered = [(i, x) for i, x in enumerate(text.split("\n")) if x.strip()]
                found, head = blocks(html) if html else ([], "")
                where = align([squeeze(x) for _, x in numbered], [squeeze(b[0]) for b in found]) if found else [-1] * len(numbered)
                if found:
                    b_rows.append(block_features(found, head))
                if -1 in where:
                    l_rows.append(text_features([x for _, x in numbered], title, site_name(head)))
                for j, ((i, _), k) in enumerate(zip(numbered, where)):
                    todo.append((page, i, nb + k, "b") if k >= 0 else (page, i, nl + j, "l"))
                nb += len(found)
                nl += len(numbered) if -1 in where else 0
            pb = by_block.predict(np.concatenate(b_rows)) if b_rows else None
            pl = by_line.predict(np.concatenate(l_rows)) if l_rows else None
            for page, i, k, which in todo:
                if (pb if which == "b" else pl)[k] >= 0.5:
                    ids.append(page)
                    numbers.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int32())], ["page_id", "line_no"])

    return pages.where("page_id is not null and text is not null").select("page_id", "title", "text", "html").mapInArrow(run, "page_id long, line_no int")
