from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from read_pages import READ

from docloom.llm import mainbody as M

SF = Path("/root/testdata/sf0.1")

PAGE = """<!doctype html><html><head><title>On rivers | The Site</title><style>.a{b:c}</style></head><body>
<div class="nav"><a href="/a">Home</a><a href="/b">News</a></div>
<div class="body"><h1>On rivers</h1><span>By Ann Other</span><time>Published 2025-01-01</time>
<p>The <b>river</b> rose in the night, and by the morning the whole of the lower town was under water.</p>
<p>Nobody had expected the bridge to hold, but it did, and the last of the carts came over it at noon.</p>
<div>Advertisement</div><h2>Background</h2><li>a list item</li><table><tr><td>Cell 5.0</td></tr></table>
<blockquote>&ldquo;It was high.&rdquo;</blockquote><p>Related: On lakes and other waters</p></div>
<div class="more"><h3>Most read</h3><a href="/c">On lakes</a></div>
<div class="foot"><p>&copy; 2025 The Site. All rights reserved.</p></div></body></html>"""


def lines(page):
    return [b[0] for b in M.blocks(page)[0]]


def test_blocks_read_inline_markup_and_entities():
    found, title = M.blocks(PAGE)
    assert title == "On rivers | The Site"
    texts = [b[0] for b in found]
    assert "The river rose in the night, and by the morning the whole of the lower town was under water." in texts
    assert "“It was high.”" in texts
    kinds = dict((b[0], b[1]) for b in found)
    assert (kinds["On rivers"], kinds["Home"], kinds["Cell 5.0"], kinds["Advertisement"]) == ("h1", "a", "cell", "box")
    box = dict((b[0], b[3]) for b in found)
    assert box["Cell 5.0"] == box["On rivers"] == box["Advertisement"] != box["Home"]
    assert dict((b[0], b[2]) for b in found)["Home"] == 4


def test_broken_markup_does_not_fail():
    for html in ("", "<", "<<>>", "<p", "</p></div>", "<div><div><p>x", "&", "<!-- open", "<td>x</table></body>", "a > b < c"):
        found, title = M.blocks(html)
        assert M.block_features(found, title).shape == (len(found), len(M.FEATURES))


def test_table(spark):
    text = "\n".join(x.upper() if i % 3 == 0 else f"  {x} " for i, x in enumerate(lines(PAGE))) + "\n\n \n"
    rows = [(1, "On rivers", text, PAGE, 5), (2, "On rivers", text, None, 5), (3, None, None, PAGE, 5), (4, None, "", PAGE, 5), (5, None, "only words here", "", 5), (None, "t", "x", None, 5), (6, "t", "word " * 200_000, "<p>" + "word " * 200_000, 5)]
    df = spark.createDataFrame(rows, "page_id long, title string, text string, html string, line_no int")
    out = M.main_lines(df).collect()
    numbered = text.split("\n")
    one = {numbered[r.line_no].strip().lower() for r in out if r.page_id == 1}
    assert one == {x.lower() for x in lines(PAGE) if x.startswith(("The river", "Nobody", "On rivers", "Background", "a list", "Cell", "“It"))}
    assert {r.page_id for r in out} <= {1, 2, 5, 6}
    assert M.main_lines(df.limit(0)).count() == 0


def test_align_is_in_order_and_knows_repeats():
    assert M.align(["a", "b", "a", "x", "c"], ["a", "b", "a", "c"]) == [0, 1, 2, -1, 3]
    assert M.align(["a"], []) == [-1]


def test_align_passes_many_left_out_blocks():
    menu = [f"m{i}" for i in range(100)]
    assert M.align(["a", "b", "c"], ["a", *menu, "b", "c"]) == [0, 101, 102]
    # a line whose own block is lost and that turns up again below takes no other line's block
    assert M.align(["home", "b", "c"], ["a", "b", "c", "home"]) == [-1, 1, 2]
    assert M.align(["a", "b"], ["a", "b", "a", "b"]) == [0, 1]


def test_tree_learns_and_is_bounded():
    rng = np.random.default_rng(0)
    x = rng.random((600, 4))
    y = ((x[:, 1] > 0.5) & (x[:, 2] <= 0.3)).astype(float)
    t = M.Tree(x, y, depth=4)
    z = rng.random((500, 4))
    assert ((t.predict(z) >= 0.5) == ((z[:, 1] > 0.5) & (z[:, 2] <= 0.3))).mean() > 0.97
    assert M.Tree(np.zeros((0, 2)), np.zeros(0)).predict(np.zeros((3, 2))).tolist() == [0, 0, 0]
    a, b = M.trees()
    assert len(a.nodes) < 400 and len(b.nodes) < 400


def test_held_out_accuracy():
    """A tree fitted on half of the labelled table decides the other half."""
    import csv

    rows = [[float(v) for v in r[1:]] for r in csv.reader(M.LABELS.open()) if r[0] == "block"]
    data = np.array(rows)
    half = len(data) // 2
    t = M.Tree(data[:half, 1:], data[:half, 0])
    assert ((t.predict(data[half:, 1:]) >= 0.5) == (data[half:, 0] == 1)).mean() > 0.97


@pytest.mark.skipif(not SF.exists(), reason="no test tables here")
@pytest.mark.parametrize(("markup", "least"), [(True, 0.99), (False, 0.85)])
def test_pages_told_by_reading(spark, markup, least):
    """Pages that no label was made of, against lines told by a reader and not by rules."""
    texts = spark.read.parquet(f"{SF}/scraped_documents.parquet").where("text is not null").dropDuplicates(["page_id"]).select("page_id", "title", "text")
    html = spark.read.parquet(f"{SF}/scrape_requests.parquet").where("html is not null").dropDuplicates(["page_id"]).select("page_id", "html" if markup else F.lit(None).cast("string").alias("html"))
    pages = texts.where(F.col("page_id").isin(list(READ))).join(html, "page_id")
    got = {}
    for r in M.main_lines(pages).collect():
        got.setdefault(r.page_id, set()).add(r.line_no)
    hits = sum(len(got[p] & main) for p, (main, _) in READ.items())
    assert hits / sum(len(main) for main, _ in READ.values()) >= least
    assert hits / sum(len(got[p] - unsure) for p, (_, unsure) in READ.items()) >= least


def test_a_long_block_is_judged_by_all_of_it():
    clean, codes = "plain words " * 30, "X9" * 300
    a, b = (M.block_features([(x, "p", 0, 0)], "")[0] for x in (clean, clean + codes))
    digits, upper = M.FEATURES.index("digits"), M.FEATURES.index("upper")
    assert a[digits] == 0 and b[digits] > 0.3 and b[upper] > 0.3
