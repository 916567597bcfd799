from datetime import datetime, timedelta

from pyspark.sql import functions as F

from docloom.operators import web as W


def test_scrape(spark):
    page = "<html><head><title> Hello </title><script>var x = 1;</script></head><body><h1>Head</h1><a href='/x'>X</a><a href=''>n</a><p>tail a&am"
    df = spark.createDataFrame([("u", page), ("n", None), ("e", "")], "url string, html string")
    rows = {r.url: r for r in W.scrape(df).collect()}
    r = rows["u"]
    assert (r.title, r.links, r.headings, r.meta) == ("Hello", ["/x"], ["Head"], {})
    assert r.text == "Hello var x = 1; Head X n"  # the unfinished run at the end is lost
    assert rows["n"].text is None
    assert (rows["e"].text, rows["e"].title) == ("", None)
    assert W.read_page(page, drop_script=True)[1] == "Hello Head X n"


def pages(spark, links):
    return spark.createDataFrame([(u, f"<title>{u[-1]}</title>" + "".join(f'<a href="{x}">x</a>' for x in out)) for u, out in links.items()], "url string, html string")


def test_crawl_levels_order_and_budget(spark):
    h = "https://example.com/"
    site = pages(spark, {h: ["/b", "/a", "https://other.example/z", "/b"], h + "a": ["/c", h], h + "b": ["/c", "/d"], h + "c": ["/e"]})
    out = W.Crawl(site, h, max_depth=2).run().orderBy("visit").collect()
    assert [(r.url, r.depth, r.parent_url) for r in out] == [(h, 0, None), (h + "b", 1, h), (h + "a", 1, h), (h + "c", 2, h + "b"), (h + "d", 2, h + "b")]
    assert [r.found for r in out] == [True, True, True, True, False]
    assert W.Crawl(site, h, max_depth=5, max_pages=3).run().count() == 3
    assert W.Crawl(site, h, max_depth=0).run().count() == 1
    assert W.Crawl(site, h, max_depth=1, same_host_only=False).run().count() == 4
    assert W.Crawl(site.limit(0), h).run().count() == 1


def test_crawl_counters(spark):
    h = "https://example.org/"
    site = pages(spark, {h: ["/p", "/q", "/r"], h + "p": [], h + "q": ["/s"]})
    out = W.crawl_counters(W.Crawl(site, h, max_depth=2).run()).orderBy("depth").collect()
    assert [(r.depth, r.visited, r.stored_pages, r.stored_urls) for r in out] == [(0, 1, 1, 1), (1, 3, 2, 2), (2, 1, 0, 0)]


def test_blob_key(spark):
    r = spark.range(1).select(W.blob_key("crawl", "https://example.com:81/x", F.lit("https://example.com/"), F.lit("text/HTML")).alias("a"), W.blob_key("crawl", "nowhere", F.lit("u"), F.lit(None)).alias("b")).first()
    assert r.a == "crawl/example.com:81/0f115db062b7c0dd.html"
    assert r.b.startswith("crawl/crawl/") and r.b.endswith(".bin")


def test_monitor(spark):
    t = datetime(2025, 1, 1)
    rows = [("u", t, 1, "a"), ("u", t + timedelta(1), 2, "a"), ("u", t + timedelta(2), 3, "b"), ("v", t, 4, "a")]
    out = W.monitor(spark.createDataFrame(rows, "url string, fetched_at timestamp, n int, body string"), tie="n").orderBy("n").collect()
    assert [r.changed for r in out] == [True, False, True, True]
    assert out[2].previous_sha256 == out[1].body_sha256


def test_segments_restart_on_overflow(spark):
    sizes = [4, 4, 4, 20, 1, 1, 1, 1, None]
    df = spark.createDataFrame(list(enumerate(sizes)), "id long, size int")
    out = W.archive_segments(df, "size", "id", writers=1, max_bytes=10, max_records=3).orderBy("id").collect()
    want, seg, used, n = [], 0, 0, 0
    for s in sizes:
        s = s or 0
        if n and (n >= 3 or used + s > 10):
            seg, used, n = seg + 1, 0, 0
        want.append((seg, n))
        used, n = used + s, n + 1
    assert [(r.segment, r.position) for r in out] == want


def test_headers_are_sanitized(spark):
    head = W.archive_headers(F.lit("id"), F.lit("x"), F.create_map(F.lit("a b!é_-"), F.lit("v\r\nw"), F.lit("!!"), F.lit("gone")), F.create_map(F.lit("ETag"), F.lit("1")), "X-")
    r = spark.range(1).select(head.alias("h")).first().h
    assert r["X-abé_-"] == "v  w"
    assert r["X-payload-header-ETag"] == "1"
    assert r["WARC-Refers-To"] == "<urn:uuid:id>"
    assert len(r) == 4


def test_envelopes(spark):
    import hashlib
    import json

    df = spark.createDataFrame([("d", 'text "ü"', {"k": "v"}), ("e", None, None)], "document_id string, text string, metadata map<string,string>")
    rows = {r.document_id: r for r in W.envelopes(df, "doc", "1", ["document_id", "text"], F.array(F.lit("p"))).collect()}
    data = {"resource_type": "doc", "schema_version": "1", "payload": {"document_id": "d", "text": 'text "ü"'}, "metadata": {"k": "v"}}
    assert rows["d"].fingerprint == hashlib.sha256(json.dumps(data, sort_keys=True).encode()).hexdigest()
    assert rows["d"].parents == ["p"]
    assert rows["e"].fingerprint != rows["d"].fingerprint


def test_ancestors(spark):
    edges = spark.createDataFrame([("d", "c"), ("c", "b"), ("b", "a"), ("d", "a"), ("x", None), ("y", "y")], "child string, parent string")
    assert {tuple(r) for r in W.ancestors(edges).collect()} == {("d", "c", 1), ("d", "b", 2), ("d", "a", 1), ("c", "b", 1), ("c", "a", 2), ("b", "a", 1)}
    assert W.ancestors(edges.limit(0)).count() == 0


def test_monitor_of_a_hot_key_equals_the_plain_window(spark):
    rows = [("hot" if i % 3 else f"k{i % 7}", i % 50, i, "abc"[(i * i) % 3]) for i in range(3000)] + [(None, i, 9000 + i, "ab"[i % 2]) for i in range(40)]
    df = spark.createDataFrame(rows, "url string, t int, n int, body string").repartition(8)
    out = W.monitor(df, "url", "body", "t", "n")
    plain = df.withColumn("d", F.sha2("body", 256)).selectExpr("n", "lag(d) over (partition by url order by t, n) as p")
    assert {(r.n, r.previous_sha256) for r in out.collect()} == {tuple(r) for r in plain.collect()}
    assert out.columns == ["url", "t", "n", "body_sha256", "previous_sha256", "changed"]
