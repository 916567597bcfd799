"""Splitting oversized texts at natural boundaries.

A text of more than ``limit`` tokens is bisected: the cut is the strongest boundary in the middle
half of the segment, the nearest to its midpoint among equals, else any boundary that leaves both
sides longer than the overlap, else the midpoint itself. Halves longer than ``limit - overlap`` are
bisected again; then each piece but the first is extended back by the last ``overlap`` tokens of
the piece before it, so no piece exceeds ``limit``. Token: a longest run of non-whitespace.
Boundaries, by strength: a blank line (3), a line break (2), a sentence end (1).

Any overlap below the limit is allowed. Where a segment is shorter than two overlaps its cut leaves a
quarter on either side instead; a first piece that is shorter than the overlap is repeated whole.

Defined results: null, empty and short texts have no pieces (they need none); a text without any
boundary is cut at midpoints; a text is always read whole, whatever its length.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

TOKEN = re.compile(r"\S+")
#: Characters that end a line, and that end a sentence before whitespace.
LINE_END = re.compile("[\n\r\x0b\x0c\x85\u2028\u2029]")
SENTENCE_END = frozenset(".!?…。！？")
PIECES = "key long, piece_no int, piece_id string, start_token int, end_token int, start_char int, end_char int, text string, tokens int, cut string"


def spans(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in TOKEN.finditer(text)]


def boundaries(text: str, at: list[tuple[int, int]]) -> dict[int, int]:
    """Token position p (a cut before token p) to the strength of the boundary there."""
    found = {}
    for p in range(1, len(at)):
        end, start = at[p - 1][1], at[p][0]
        if start - end == 1:
            c = text[end]
            breaks = 1 if c != " " and LINE_END.match(c) else 0
        else:
            breaks = len(LINE_END.findall(text[end:start].replace("\r\n", "\n")))
        if breaks:
            found[p] = 3 if breaks > 1 else 2
        elif text[end - 1] in SENTENCE_END:
            found[p] = 1
    return found


def longest_stretch(n: int, found: dict[int, int]) -> int:
    edges = [0, *sorted(found), n]
    return max(b - a for a, b in zip(edges, edges[1:]))


def bisect(n: int, found: dict[int, int], limit: int, overlap: int) -> list[int]:
    """Ends of the bodies of the pieces of n tokens."""
    body, order, done = limit - overlap, sorted(found), []
    stack = [(0, n)]
    while stack:
        a, b = stack.pop()
        if b - a <= body:
            done.append(b)
            continue
        middle = (a + b) // 2
        quarter = (b - a) // 4

        def best(low: int, high: int, strong: bool) -> int | None:
            inside = order[bisect_left(order, low) : bisect_left(order, high + 1)]
            if not inside:
                return None
            return min(inside, key=lambda p: ((-found[p] if strong else 0), abs(p - middle), p))

        least = max(1, overlap if 2 * overlap < b - a else quarter)
        cut = best(a + max(quarter, least), b - max(quarter, least), True)
        if cut is None:
            cut = best(a + least, b - least, False)
        if cut is None:
            cut = middle
        stack += [(cut, b), (a, cut)]  # the left half first
    return done


def split_text(text: str, limit: int = 128, overlap: int = 16) -> list[tuple[int, int, str]]:
    """(start token, end token, cut) of each piece; none for a text within the limit."""
    at = spans(text)
    return _split(text, at, limit, overlap)


def _split(text: str, at: list[tuple[int, int]], limit: int, overlap: int) -> list[tuple[int, int, str]]:
    n = len(at)
    if n <= limit:
        return []
    found = boundaries(text, at)
    kind = "forced" if longest_stretch(n, found) > limit else "natural"
    ends = bisect(n, found, limit, overlap)
    starts = [0, *[max(0, e - overlap) for e in ends[:-1]]]
    return [(s, e, kind) for s, e in zip(starts, ends)]


def split_oversized(df: DataFrame, limit: int = 128, overlap: int = 16) -> DataFrame:
    """``df`` (key long, text string; one row per key) to the pieces of every oversized text.

    ``cut`` is forced if some stretch without a boundary inside is longer than ``limit``, else
    natural; it is the same for all pieces of a text. ``piece_id`` is ``key:index``.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap is smaller than the limit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(*(c.to_pylist() for c in batch.columns)):
                if len(text) < 2 * limit:  # too short for more than limit tokens
                    continue
                at = spans(text)
                for i, (s, e, kind) in enumerate(_split(text, at, limit, overlap)):
                    a, z = at[s][0], at[e - 1][1]
                    rows.append((key, i, f"{key}:{i}", s, e, a, z, text[a:z], e - s, kind))
            cols = list(zip(*rows)) or [()] * 10
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], ["key", "piece_no", "piece_id", "start_token", "end_token", "start_char", "end_char", "text", "tokens", "cut"])

    return df.where("key is not null and text is not null").select("key", "text").mapInArrow(run, PIECES)
