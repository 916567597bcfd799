import pytest

from docloom.operators import search as S
from docloom.operators import vectors as V


def test_boosts_weigh_fields(spark):
    rows = [(1, "red fox", None), (2, "fox", "red red"), (3, None, "fox"), (4, "", "nothing")]
    df = spark.createDataFrame(rows, "document_id long, title string, text string")
    out = S.search_boosted(df, "Red fox", {"title": 2.0, "text": 1.0, "absent": 9.0}).collect()
    assert [(r.document_id, r.score) for r in out] == [(1, 4.0), (2, 3.0), (3, 1.0)]
    assert S.search_boosted(df, "", {"title": 1.0}).count() == 0


@pytest.mark.parametrize("block", [2, 1024])
def test_many_queries_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(V, "QUERY_BLOCK", block)
    monkeypatch.setattr(V, "RECORD_BLOCK", 3)
    rows = [(i, [float(i % 4), 1.0, float(i % 3)][: 2 + i % 2]) for i in range(10)] + [(99, None), (98, [])]
    records = spark.createDataFrame(rows, "record_id long, vector array<double>")
    queries = spark.createDataFrame([(f"q{i}", [1.0, float(i), 0.5]) for i in range(5)] + [("none", None)], "query_id string, query array<double>")
    got = {(r.query_id, r["rank"]): (r.record_id, round(r.score, 9)) for r in V.top_k_many(records, queries, 3).collect()}
    assert len(got) == 15
    for i in range(5):
        one = V.top_k(records.where("vector is not null"), [1.0, float(i), 0.5], 3).collect()
        assert [got[(f"q{i}", n + 1)] for n in range(3)] == [(r.record_id, round(r.score, 9)) for r in one]
    assert V.top_k_many(records.limit(0), queries, 3).count() == 0


def test_another_embedder(spark):
    df = spark.createDataFrame([("a", "abc", "d", "c", None), ("b", "a", "d", "c", None)], "record_id string, text string, document_id string, chunk_id string, metadata map<string,string>")
    from pyspark.sql import functions as F

    made = V.embed(df, dim=2, embedder=lambda c, dim: F.array(F.length(c).cast("double"), F.lit(1.0))).withColumnRenamed("values", "vector").withColumn("namespace", F.lit("default"))
    hit = V.retrieve(made, "xxx", 1, dim=2, embedder=lambda q, dim: [float(len(q)), 1.0]).first()
    assert (hit.record_id, round(hit.score, 6)) == ("a", 1.0)
