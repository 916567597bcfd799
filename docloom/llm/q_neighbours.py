"""Problem 5: the most similar vectors of every vector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.neighbours import Neighbours, current_vectors
from docloom.operators.vectors import cosine
from docloom.storage import table

DIM, K, NEAR = 64, 10, 0.9


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return current_vectors(table(spark, sf, "vector_records"), "namespace", "record_id", "vector", "loaded_at", DIM)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    near = Neighbours(_vectors(spark, sf), DIM, K, least=NEAR).pairs()
    return near.select(F.least("id", "other").alias("record_a"), F.greatest("id", "other").alias("record_b")).distinct()


def p5_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The 10 most similar of every record whose number is divisible by 20, searched in the index of all."""
    search = Neighbours(_vectors(spark, sf), DIM, K)
    asked = search.records.where(F.regexp_extract("id", "([0-9]+)$", 1).try_cast("bigint") % 20 == 0).select("grp", "id")
    return search.pairs(asked).select(F.col("grp").alias("namespace"), F.col("id").alias("record_id"), "rank", F.col("other").alias("neighbour_id"), F.round("cosine", 6).alias("cosine"))


def p5_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Of the same records: how many neighbours each has, and whether ranks, order, namespace and cosines hold."""
    now = _vectors(spark, sf).select("grp", "id", F.col("vec").cast("array<double>").alias("v"))
    top = p5_topk(spark, sf)
    sides = top.join(now.select(F.col("grp").alias("namespace"), F.col("id").alias("record_id"), F.col("v").alias("a")), ["namespace", "record_id"])
    sides = sides.join(now.select(F.col("grp").alias("namespace"), F.col("id").alias("neighbour_id"), F.col("v").alias("b")), ["namespace", "neighbour_id"])
    mine = Window.partitionBy("namespace", "record_id").orderBy("rank")
    right = F.abs(cosine(F.col("a"), F.col("b")) - F.col("cosine")) < 1e-5
    ordered = F.coalesce(F.lag("cosine").over(mine) >= F.col("cosine"), F.col("rank") == 1)
    checked = sides.select("namespace", "record_id", "rank", (right & ordered & (F.col("record_id") != F.col("neighbour_id"))).alias("ok"))
    return checked.groupBy("namespace", "record_id").agg(F.count(F.lit(1)).alias("n"), (F.bool_and("ok") & (F.max("rank") == F.count(F.lit(1)))).alias("kept"))


_OK = """
with now as (select namespace, record_id, arg_max({'v': vector}, loaded_at).v as v from vector_records where record_id is not null and namespace is not null group by 1, 2),
ok as (select namespace, record_id from now where len(v) = 64 and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0)
"""
_SQL = """
with now as (select namespace, record_id, arg_max({'v': vector}, loaded_at).v as v from vector_records where record_id is not null group by 1, 2),
ok as (select namespace, record_id, v::double[] as v from now where len(v) = 64 and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0),
sim as (select a.namespace, a.record_id as a, b.record_id as b, list_cosine_similarity(a.v, b.v) as s from ok a join ok b on a.namespace = b.namespace and a.record_id <> b.record_id),
top as (select a, b, s, row_number() over (partition by namespace, a order by s desc, b) as r from sim)
select distinct least(a, b) as record_a, greatest(a, b) as record_b from top where r <= 10 and s >= 0.9
"""

QUERIES = {"p5_found": p5_found, "p5_topk": p5_topk, "p5_ranks": p5_ranks}
SQL = {
    "p5_found": _SQL,
    "p5_ranks": _OK + "select * from (select namespace, record_id, least(10, count(*) over (partition by namespace) - 1) as n, true as kept from ok) where try_cast(regexp_extract(record_id, '([0-9]+)$', 1) as bigint) % 20 = 0 and n > 0",
}
