"""Problem 4: pairwise duplicate decisions consolidated into groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.groups import clean_id, connected_groups, edges
from docloom.storage import table


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = table(spark, sf, "dedup_decisions")
    return connected_groups(edges(pairs, clean_id(F.col("duplicate_document_id")), clean_id(F.col("canonical_document_id"))))


def p4_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """How many groups there are of each size."""
    sizes = p4_found(spark, sf).groupBy("group_id").agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy("size").agg(F.count(F.lit(1)).alias("groups"))


_SQL = r"""
with recursive e as (
  select distinct x as a, y as b from (
    select lower(regexp_replace(duplicate_document_id, '^\s+|\s+$', '', 'g')) as x, lower(regexp_replace(canonical_document_id, '^\s+|\s+$', '', 'g')) as y from dedup_decisions)
  where x <> '' and y <> '' and x <> y),
dbl as (select a, b from e union select b, a from e),
reach(a, b) as (select a, b from dbl union select r.a, k.b from reach r join dbl k on r.b = k.a),
groups as (select least(a, min(b)) as group_id, a as document_id from reach group by a)
"""

QUERIES = {"p4_found": p4_found, "p4_sizes": p4_sizes}
SQL = {
    "p4_found": _SQL + "select group_id, document_id from groups",
    "p4_sizes": _SQL + "select size, count(*) as groups from (select count(*) as size from groups group by group_id) group by 1",
}
