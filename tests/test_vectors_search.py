import math

import pytest
from pyspark.sql import functions as F

from docloom.operators import search as S
from docloom.operators import vectors as V
from docloom.operators.documents import Rule
from docloom.plans.knowledge import knowledge, knowledge_run

RECORD = "record_id string, namespace string, vector array<double>, document_id string, chunk_id string, text string, metadata map<string,string>, at int"


def test_embedding(spark):
    df = spark.createDataFrame([("hello world",), ("",), (None,), ("ß only",)], "text string")
    a, b, c, _ = (r["values"] for r in V.embed(df).collect())
    assert len(a) == 64
    assert math.isclose(sum(x * x for x in a), 1)
    assert [i for i, x in enumerate(a) if x] == [14, 15]
    assert not any(b)
    assert c is None
    with pytest.raises(ValueError):
        V.hash_embedding(F.col("text"), 63)


def test_top_k_filters_and_prefix(spark):
    rows = [("doc-1", "default", [1.0, 0.0], "d1", None, None, {"lang": "en"}, 1), ("doc-2", "default", [0.0, 1.0], "d2", None, None, None, 1), ("doc-3", "other", [1.0, 0.0], "d3", None, None, None, 1), ("doc-4", "default", [], "d4", None, None, None, 1), ("doc-5", "default", [0.0, 0.0, 1.0], "d5", None, None, None, 1)]
    df = spark.createDataFrame(rows, RECORD)
    top = V.top_k(df, [0.9, 0.1], 5, "default").collect()
    assert [r.record_id for r in top] == ["doc-1", "doc-2", "doc-4", "doc-5"]
    assert math.isclose(top[0].score, 0.993884, abs_tol=1e-6)
    assert math.isclose(top[1].score, 0.110432, abs_tol=1e-6)
    assert [r.record_id for r in V.top_k(df, [1, 0], 5, "default", {"lang": "en"}).collect()] == ["doc-1"]
    assert {r.record_id for r in V.top_k(df, [1, 0], 5, "default", {"lang": None}).collect()} == {"doc-2", "doc-4", "doc-5"}
    many = V.top_k_many(df, spark.createDataFrame([("q1", [0.9, 0.1]), ("q2", [0.0, 1.0])], "query_id string, query array<double>"), 2).collect()
    assert {(r.query_id, r.record_id, r["rank"]) for r in many} == {("q1", "doc-1", 1), ("q1", "doc-3", 2), ("q2", "doc-2", 1), ("q2", "doc-1", 2)}
    with pytest.raises(ValueError):
        V.top_k(df, [1.0], 0)


def test_upsert_keeps_the_last(spark):
    rows = [("a", "n", [1.0], "d", None, "old", None, 1), ("a", "n", None, "d", None, "new", None, 2), ("a", "m", [3.0], "d", None, "x", None, None)]
    out = {(r.namespace, r.record_id): r for r in V.upsert(spark.createDataFrame(rows, RECORD), "at").collect()}
    assert len(out) == 2
    assert out[("n", "a")].text == "new"
    assert out[("n", "a")].vector is None


def test_provenance_of_hits(spark):
    rows = [("r1", "default", V.hash_vector("vector store"), "d1", "c1", "t", {"provenance": '{"source_resource_id": "res-1", "chunk_index": "0"}'}, 1), ("r2", "default", V.hash_vector("cat"), "d2", None, "t", {"k": "v"}, 1)]
    hits = {r.record_id: r for r in V.retrieve(spark.createDataFrame(rows, RECORD), "vector", 2).collect()}
    assert hits["r1"].provenance["source_resource_id"] == "res-1"
    assert hits["r1"].provenance["document_id"] == "d1"
    assert hits["r2"].provenance["k"] == "v"


def test_flagship_case(spark):
    text = "Engine normalizes text, enriches it, deduplicates it, and retrieves the best chunk."
    docs = spark.createDataFrame([("doc-1", "The cat sat on the mat.", {"source": "story"}), ("doc-2", text, {"source": "knowledge"}), ("doc-3", text, {"source": "knowledge"})], "document_id string, text string, metadata map<string,string>")
    rules = [Rule("basic", required_metadata_keys=("source",), min_unique_words=3)]
    hits = knowledge(docs, "How does Engine retrieve the best chunk?", rules, 2).collect()
    assert [(r.document_id, r.score) for r in hits] == [("doc-2", 0.485363), ("doc-1", 0.196116)]


def test_flagship_runs_all_stages(spark):
    long = " ".join(f"word{i} Engine" for i in range(100))
    rows = [("a", 1, "Old  engine text here.", {"source": "x"}), ("a", 2, "New engine text here.", {"source": "x"}), ("b", 3, long, {"source": "y"}), ("c", 4, long, {"source": "y"}), ("d", 5, "No source at all.", {}), ("e", 6, None, {"source": "z"})]
    docs = spark.createDataFrame(rows, "document_id string, seq long, text string, metadata map<string,string>")
    run = knowledge_run(docs, "engine text", [Rule("basic", required_metadata_keys=("source",), min_unique_words=3)], 9, order="seq")
    out = {k: v.collect() for k, v in run.results.items()}
    stages = ["normalize", "enrich", "dedup", "compliance", "chunk", "provenance", "embed", "upsert", "retrieve"]
    assert [s for s in run.plan.order if s in stages] == stages and set(run.states.values()) == {"succeeded"}
    assert {"enrich", "provenance"} == set(run.checkpoints)
    assert {r.document_id: r.keywords for r in out["enrich"]}["a"]
    assert len(out["provenance"]) == len(out["chunk"]) == 4
    assert len({r.resource_id for r in out["provenance"]}) == 4
    assert all(len(r.fingerprint) == 64 and r.parents == [r.document_id] and r.metadata["source"] in "xy" for r in out["provenance"])
    # records of one id are collapsed, the last stays
    assert sorted(r.record_id for r in out["upsert"]) == ["a:0", "b:0", "b:1"]
    assert {r.record_id: r.text for r in out["retrieve"]}["a:0"] == "new engine text here."
    assert len(out["retrieve"]) == 3


def test_search(spark):
    rows = [("doc-1", "hello world", "Hello", None), ("doc-2", "nothing", None, "http://hello.example"), ("doc-3", None, None, None), ("doc-4", "x" * 200, None, None)]
    df = spark.createDataFrame(rows, "document_id string, text string, title string, url string")
    hits = S.search(df, "hello hello world").collect()
    assert [(r.document_id, r.score, r.snippet) for r in hits] == [("doc-1", 3.0, "hello world"), ("doc-2", 2.0, "nothing")]
    assert S.search(df, "").count() == 0
    many = S.search_many(S.postings(df), spark.createDataFrame([("q", "hello hello world")], "query_id string, query string")).collect()
    assert [(r.document_id, r.score) for r in many] == [("doc-1", 3.0), ("doc-2", 2.0)]
    long = "y" * 100 + " needle  in\nthe " + "z" * 50
    one = spark.createDataFrame([(long,), ("",)], "t string").select(S.snippet(F.col("t"), ["needle"])).collect()
    assert one[0][0] == " ".join(long[61:125].split())
    assert one[1][0] is None
