"""Consolidating pairwise matches into groups (connected components).

1. Pairs become distinct undirected edges (the smaller id first) between numbers in the ids' order.
2. The component of the vertex of highest degree, usually the giant one, is peeled off by frontier
   breadth-first joins; every round takes the frontier's edges out of the rest. Should its far ends
   be long chains, the walk stops after ``peel_rounds`` and the peeled part goes on as one vertex,
   so nothing is lost.
3. The remaining components are labelled by minimum propagation over the edges in alternating
   large-star and small-star rounds (Kiveris et al. 2014): plain propagation needs as many rounds
   as a chain is long, this needs about the logarithm, and every round keeps the components.
   Finished components leave every second round, so long chains cost rounds over themselves only.

Each round is a table in the shared folder; nothing of the graph reaches the driver but counts and
the id of the peeled vertex, and no join is broadcast. Hot vertices are combined before the shuffle
and their joins split by the adaptive skew join.

Defined results: a pair with a null or empty side or twice the same id links nothing; repeated
pairs count once; an empty table gives no groups; the group id is the smallest id of the group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import SPACE_CHARS
from docloom.storage import Staging


def clean_id(c: Column) -> Column:
    return F.lower(F.btrim(c, F.lit(SPACE_CHARS)))


def edges(pairs: DataFrame, left: Column, right: Column) -> DataFrame:
    """Distinct edges (a, b), a < b."""
    return _ordered(pairs.where((left != "") & (right != "")), left, right)


def _ordered(pairs: DataFrame, left: Column, right: Column) -> DataFrame:
    p = pairs.select(left.alias("x"), right.alias("y")).where("x <> y")
    return p.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _both_ways(e: DataFrame) -> DataFrame:
    return e.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v")


def _pointed(rows: DataFrame, least: DataFrame, on: str) -> DataFrame:
    """Joins each vertex's least neighbour to its rows.

    Both sides are written tables, so a hot vertex is split by the adaptive skew join; the hint keeps
    either side from being collected for a broadcast, however small the planner thinks it.
    """
    return rows.join(least.hint("merge"), on)


def _star_round(e: DataFrame, staging: Staging) -> DataFrame:
    """One large-star and one small-star step over edges (smaller a, larger b)."""
    both = _both_ways(e)
    least = staging.put(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    # every larger neighbour of u points to the smallest of u and its neighbours
    large = staging.put(_pointed(both.where("v > u"), least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")))
    lower = staging.put(large.groupBy("b").agg(F.min("a").alias("m")))
    # u and its smaller neighbours point to the smallest of them
    moved = _pointed(large, lower, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    out = staging.put(moved.unionByName(lower.select(F.col("m").alias("a"), "b")).distinct())
    staging.drop(least, large, lower)
    return out


def _settled(e: DataFrame, staging: Staging) -> tuple[DataFrame, DataFrame]:
    """Edges of components that still move, and those of finished stars, which no later round reads.

    A vertex is busy if it points to two vertices, or points and is pointed to; a star is finished if
    neither its centre nor any of its leaves is busy.
    """
    ends = e.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.lit(1).alias("low"), F.lit(0).alias("high")), F.struct(F.col("b").alias("u"), F.lit(0).alias("low"), F.lit(1).alias("high")))).alias("x")).select("x.*")
    busy = ends.groupBy("u").agg(F.sum("low").alias("low"), F.sum("high").alias("high")).where("high > 1 or (high > 0 and low > 0)").select("u")
    busy = staging.put(busy)
    touched = e.join(busy.hint("merge").withColumnRenamed("u", "b"), "b", "left_semi").select("a")
    centres = touched.unionByName(busy.withColumnRenamed("u", "a")).distinct().withColumn("moves", F.lit(True))
    marked = staging.put(e.join(centres.hint("merge"), "a", "left"))
    staging.drop(busy)
    return marked.where("moves").select("a", "b"), marked.where("moves is null").select("a", "b")


def _numbered(e: DataFrame, staging: Staging) -> tuple[DataFrame, DataFrame]:
    """A table (id, num, n) of the vertices with their degrees, and the edges in numbers.

    The numbers follow the order of the ids (they are given along a range-partitioned sort), so the
    smallest number of a group is that of its smallest id, and every round works on longs.
    """
    degrees = _both_ways(e).groupBy(F.col("u").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    names = staging.put(degrees.orderBy("id").select("id", "n", F.monotonically_increasing_id().alias("num")))
    side = lambda c: names.hint("merge").select(F.col("id").alias(c), F.col("num").alias(f"n{c}"))
    numbers = e.join(side("a"), "a").join(side("b"), "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
    return names, staging.put(numbers)


def connected_groups(e: DataFrame, peel_rounds: int = 6, max_rounds: int = 100, staging: Staging | None = None) -> DataFrame:
    """(group_id, document_id) for every vertex of the edges (a, b)."""
    staging = staging or Staging(e.sparkSession, "groups")
    names, e = _numbered(staging.put(e), staging)
    top = names.agg(F.max(F.struct("n", "num")).alias("t")).first()["t"]
    if top is None:
        return names.select(F.col("id").alias("group_id"), F.col("id").alias("document_id"))
    labels = staging.put(_labelled(e, top["num"], peel_rounds, max_rounds, staging))
    side = lambda c: names.hint("merge").select(F.col("num").alias(c), F.col("id").alias(f"{c}_id"))
    named = labels.join(side("g"), "g").join(side("v"), "v")
    return named.select(F.col("g_id").alias("group_id"), F.col("v_id").alias("document_id"))


def _labelled(e: DataFrame, hub: int, peel_rounds: int, max_rounds: int, staging: Staging) -> DataFrame:
    """(g, v): the smallest number of each vertex's component."""
    inside = staging.put(e.sparkSession.createDataFrame([(hub,)], "u long"))
    walked, rest = [inside], e
    for step in range(peel_rounds + 1):
        # edges at the frontier leave; their far ends are the next frontier, and no earlier one is among them
        marked = rest.join(inside.hint("merge").select(F.col("u").alias("a"), F.lit(True).alias("ia")), "a", "left")
        marked = staging.put(marked.join(inside.hint("merge").select(F.col("u").alias("b"), F.lit(True).alias("ib")), "b", "left"))
        rest = marked.where("ia is null and ib is null").select("a", "b")
        fresh = staging.put(marked.where("ia is null or ib is null").where("ia or ib").select(F.when(F.col("ia"), F.col("b")).otherwise(F.col("a")).alias("u")).distinct())
        if fresh.isEmpty():
            break
        walked.append(fresh)
        inside = fresh
    peeled = reduce(DataFrame.unionByName, walked)
    least = peeled.agg(F.min("u").alias("m")).first()["m"]
    if step == peel_rounds:  # the walk stopped before its end: what it reached goes on as one vertex
        rest = rest.join(inside.hint("merge").select(F.col("u").alias("a"), F.lit(True).alias("ia")), "a", "left")
        rest = rest.join(inside.hint("merge").select(F.col("u").alias("b"), F.lit(True).alias("ib")), "b", "left")
        rest = _ordered(rest, F.when(F.col("ia"), F.lit(least)).otherwise(F.col("a")), F.when(F.col("ib"), F.lit(least)).otherwise(F.col("b")))
    now, stars = staging.put(rest), []
    for turn in range(max_rounds):
        if now.isEmpty():
            break
        now = _star_round(now, staging)
        if turn % 2:
            now, finished = _settled(now, staging)
            stars.append(finished)
    else:
        raise RuntimeError("the groups did not settle")
    now = reduce(DataFrame.unionByName, stars, now)
    label = now.where(F.col("b") == least).select("a").first()
    label = label["a"] if label else least
    stars = now.select(F.col("a").alias("g"), F.col("b").alias("v"))
    centres = now.select(F.col("a").alias("g"), F.col("a").alias("v")).distinct()
    giant = peeled.select(F.lit(label).alias("g"), F.col("u").alias("v"))
    # the peeled part's own least vertex went on; it must not come out twice
    return stars.unionByName(centres).where(F.col("v") != least).unionByName(giant)
