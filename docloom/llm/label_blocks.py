"""Writes the labelled table of the main-body trees: label_blocks.py SCRAPED REQUESTS [PAGES].

The labels follow a reading of a few hundred pages: in the box of the article's heading, headings,
paragraphs, list items, quotations and table cells are main content; bylines, dates, adverts, share
prompts, links to other pages and notes on author or publisher are not; outside it nothing is.
Only features and labels are written, no page.
"""

from __future__ import annotations

import csv
import re
import sys

import numpy as np
import pyarrow.parquet as pq

from docloom.llm.mainbody import FEATURES, LABELS, align, block_features, blocks, site_name, squeeze, text_features

NOTE = re.compile(r"has written for|schreibt seit|escribe en|the views above|are those of their authors|geben die meinung|ansichten|opiniones", re.I)


def label(found: list, title: str) -> np.ndarray:
    x = block_features(found, title)
    col = lambda name: x[:, FEATURES.index(name)]
    out = np.zeros(len(found))
    for i, (b, home, site, colon, sentence, words) in enumerate(zip(found, col("home_box"), col("names_site"), col("early_colon"), col("sentence"), col("words"))):
        if not home:
            continue
        text, kind = b[0].strip(), b[1]
        if kind in ("h1", "h", "li", "quote", "cell"):
            out[i] = 1
        elif kind == "p":
            out[i] = not (site or NOTE.search(text) or (colon and not sentence and words <= 20))
        elif kind == "box":
            out[i] = text[0] in "“„«»"
    return out


def rows_of(text: str, title: str | None, html: str) -> tuple[list, list]:
    found, head = blocks(html)
    y = label(found, head)
    lines = [x for x in text.split("\n") if x.strip()]
    where = align([squeeze(x) for x in lines], [squeeze(b[0]) for b in found])
    a = [["block", int(v), *(round(float(c), 3) for c in r)] for v, r in zip(y, block_features(found, head))]
    b = [["line", int(y[k]), *(round(float(c), 3) for c in r)] for k, r in zip(where, text_features(lines, title, "")) if k >= 0]
    return a, b


def main(scraped: str, requests: str, pages: int) -> None:
    html = {r["page_id"]: r["html"] for r in pq.read_table(requests, columns=["page_id", "html"]).to_pylist() if r["html"]}
    texts = {r["page_id"]: r for r in pq.read_table(scraped, columns=["page_id", "title", "text"]).to_pylist() if r["text"]}
    out = []
    for page in sorted(set(html) & set(texts))[:pages]:
        a, b = rows_of(texts[page]["text"], texts[page]["title"], html[page])
        out += a + b
    seen: dict[tuple, int] = {}
    for r in out:
        seen[tuple(r)] = seen.get(tuple(r), 0) + 1
    with LABELS.open("w", newline="") as f:
        w = csv.writer(f)
        for r, n in seen.items():
            w.writerows([[f"{v:g}" if isinstance(v, float) else v for v in r]] * min(n, 2))


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2], int(sys.argv[3]) if len(sys.argv) > 3 else 300)
