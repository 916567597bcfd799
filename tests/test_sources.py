import json
from datetime import datetime, timezone
from enum import Enum
from pathlib import PurePosixPath
from uuid import UUID

import pytest
from pyspark.sql import functions as F

from docloom.sources import fetch, settings, tables, warc
from docloom.sources.blobs import BlobStore, check_key
from docloom.storage import STAGED, Staging, shared_folder, sweep


@pytest.mark.parametrize("key", ["", "/a", "a/../b", "a//b", "./a", "a/", "a\\b", ".."])
def test_bad_blob_keys(key):
    with pytest.raises(ValueError):
        check_key(key)


def test_blobs(spark, tmp_path):
    store = BlobStore(f"file://{tmp_path}")
    store.put("a/b.bin", b"1")
    store.put("a/b.bin", b"22")
    assert store.get("a/b.bin") == b"22"
    assert store.get("a/none") is None
    df = spark.createDataFrame([("x/1.html", b"abc"), ("x/2.html", b""), (None, b"z"), ("y", None)], "key string, content binary")
    assert {tuple(r) for r in store.write(df).collect()} == {("x/1.html", 3), ("x/2.html", 0)}
    assert {(r.key, bytes(r.content)) for r in store.read(spark, "*.html").collect()} == {("x/1.html", b"abc")}
    assert store.delete("a/b.bin")
    assert not store.delete("a/b.bin")


def test_keyed_table_merges_and_repeats(spark, tmp_path):
    t = tables.KeyedTable(spark, f"file://{tmp_path}/t", ["k"], ["at"])
    assert t.read() is None
    rows = lambda *x: spark.createDataFrame(list(x), "k string, v int, at int")
    t.merge(rows(("a", 1, 1), ("a", 2, 2), ("b", 1, 1)))
    t.merge(rows(("a", 3, 1), ("c", 1, 1)))
    t.merge(rows(("a", 3, 1), ("c", 1, 1)))
    t.merge(rows(("b", 5, 5)))
    assert {tuple(r) for r in t.read().collect()} == {("a", 2, 2), ("b", 5, 5), ("c", 1, 1)}


def test_keyed_table_compacts_and_keeps_its_rows(spark, tmp_path):
    t = tables.KeyedTable(spark, f"file://{tmp_path}/t", ["k"], ["at"], compact_every=3)
    for i in range(9):
        t.merge(spark.createDataFrame([(i % 4, i, i), (100 + i, i, i)], "k int, v int, at int"))
        want = {(j % 4, j) for j in range(max(0, i - 3), i + 1)} | {(100 + j, j) for j in range(i + 1)}
        assert {(r.k, r.v) for r in t.read().collect()} == want
    assert len(t._parts()) <= 4 and t._numbers("v")
    t.compact()
    t.compact()
    assert len(t._parts()) == 1 and t.read().count() == 13


def test_artifacts(spark, tmp_path):
    t = tables.ArtifactTable(spark, f"file://{tmp_path}/a")
    assert t.get("x") is None
    t.put("x", b"one", datetime(2025, 1, 1))
    t.put("x", b"two", datetime(2025, 1, 2))
    t.put("y", b"", datetime(2025, 1, 2))
    assert (t.get("x"), t.get("y"), t.get("z")) == (b"two", b"", None)
    assert {(r.key, r.size) for r in t.read().collect()} == {("x", 3), ("y", 0)}
    with pytest.raises(Exception, match="an artifact has a key"):
        t.put(None, b"", datetime(2025, 1, 2))


class Colour(Enum):
    RED = "red"


def test_tagged_json_round_trip():
    value = {"at": datetime(2025, 1, 1, tzinfo=timezone.utc), "id": UUID(int=5), "p": PurePosixPath("/x"), "c": Colour.RED, "s": {"b", "a"}, "n": [1, None, {"x": (2,)}]}
    text = json.dumps(tables.encode(value))
    back = tables.decode(json.loads(text), {"Colour": Colour})
    assert back == {**value, "s": ["a", "b"], "n": [1, None, {"x": [2]}]}
    assert tables.decode(json.loads(text))["c"] == "red"


def test_metadata_table(spark, tmp_path):
    m = tables.MetadataTable(spark, f"file://{tmp_path}/m")
    m.put([("n", "b", {"x": 1}), ("n", "a", 2), ("m", "z", [UUID(int=1)])], datetime(2025, 1, 1))
    m.put([("n", "b", {"x": 2})], datetime(2025, 1, 2))
    assert m.get("n", "b") == {"x": 2}
    assert m.get("m", "z") == [UUID(int=1)]
    assert m.get("n", "no") is None
    assert [(r.namespace, r.key) for r in m.listing().collect()] == [("m", "z"), ("n", "a"), ("n", "b")]
    assert m.listing("n").count() == 2


def test_archive_round_trip(spark, tmp_path):
    rows = [(i, f"https://example.com/{i}", f"page {i}\r\n\r\nbody".encode()) for i in range(20)] + [(99, None, b"x"), (98, "u", None)]
    df = spark.createDataFrame(rows, "id long, url string, content binary")
    out = warc.write_archive(df, f"file://{tmp_path}", "id", at=datetime(2025, 1, 1, tzinfo=timezone.utc), writers=2, max_records=4).collect()
    assert {r.id for r in out} == set(range(20))
    found = [x for p in sorted({r.path for r in out}) for x in warc.read_archive(p)]
    assert sorted(c for _, c in found) == sorted(c for _, _, c in rows[:20])
    assert all(h["WARC-Payload-Digest"].startswith("sha256:") for h, _ in found)
    assert len({r.path for r in out}) >= 5


def test_settings(tmp_path):
    (tmp_path / "a.json").write_text('{"a": {"b": 1, "c": 2}, "password": "x"}')
    (tmp_path / "b.toml").write_text("[a]\nb = 5\n")
    merged = settings.merge(settings.load_mapping(tmp_path / "a.json"), settings.load_mapping(tmp_path / "b.toml"), settings.from_environment("APP", {"APP_A__C": "7", "APP_NAME": "n", "OTHER": "1"}))
    assert merged == {"a": {"b": 5, "c": 7}, "password": "x", "name": "n"}
    assert settings.redacted(merged)["password"] == "***"
    for name, text in (("c.ini", ""), ("d.json", "[1]")):
        (tmp_path / name).write_text(text)
        with pytest.raises(ValueError):
            settings.load_mapping(tmp_path / name)


def test_fetch_from_pages(spark):
    pages = spark.createDataFrame([("https://a/", "<p>ü"), ("https://a/", "<p>ü"), ("https://b/", None)], "url string, html string")
    asked = spark.createDataFrame([("https://a",), ("https://b",), ("https://c/x",), (None,)], "url string").select(fetch.complete_url(F.col("url")).alias("url"))
    out = {r.url: r for r in fetch.fetch_from_table(asked, pages).collect()}
    assert (out["https://a/"].status_code, bytes(out["https://a/"].content).decode(), out["https://a/"].content_length) == (200, "<p>ü", 5)
    assert {u: r.status_code for u, r in out.items() if u} == {"https://a/": 200, "https://b/": 404, "https://c/x": 404}


def test_http_errors_are_rows(spark):
    asked = spark.createDataFrame([("http://127.0.0.1:9/none",)], "url string")
    r = fetch.fetch_http(asked, timeout=2, tasks=1, attempts=1).first()
    assert r.status_code is None
    assert "Error" in r.error


def test_staging_cuts_lineage(spark):
    s = Staging(spark, "t")
    a = s.put(spark.range(5))
    assert a.count() == 5
    assert "Range" not in a._jdf.queryExecution().optimizedPlan().toString()
    s.drop(a)
    with pytest.raises(Exception):
        a.count()


def test_staged_tables_are_cleared_and_swept(spark):
    a, b = Staging(spark, "a"), Staging(spark, "b")
    a.put(spark.range(3))
    kept = b.put(spark.range(4))
    a.clear()
    assert sweep(spark, 3600) == 0 and kept.count() == 4
    assert sweep(spark, -5) >= 1
    with pytest.raises(Exception):
        spark.read.parquet(f"{b.base}/00001").count()
    assert STAGED in b.base and b.base.startswith(shared_folder(spark))


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = type("C", (), {"get": staticmethod(lambda k, d=None: None)}), Context

    with pytest.raises(RuntimeError):
        shared_folder(Session)
