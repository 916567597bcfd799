"""Keyword search: one point for each query token that a document's text, title or url contains."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import squeeze, words
from docloom.operators.skew import salted_join

_WORD = re.compile(r"[A-Za-z0-9']+")


def query_tokens(query: str) -> list[str]:
    return [t.lower() for t in _WORD.findall(query)]


def document_tokens(df: DataFrame) -> Column:
    """Distinct lower-case tokens of text, title and url (those columns that are there)."""
    parts = [words(F.lower(F.coalesce(F.col(c), F.lit("")))) for c in ("text", "title", "url") if c in df.columns]
    return F.array_distinct(F.concat(*parts))


def snippet(text: Column, tokens: list[str], width: int = 24, before: int = 40, whole: int = 120) -> Column:
    """The text around the first place of any token, on one line; its start if there is none."""
    start = F.substring(text, 1, whole)
    if not tokens:
        return F.when(text != "", start)
    low = F.lower(text)
    at = F.array_min(F.filter(F.array(*[F.instr(low, t) for t in tokens]), lambda x: x > 0)) - 1
    begin = F.greatest(at - before, F.lit(0))
    cut = squeeze(F.substring(text, begin + 1, at + width - begin))
    return F.when(text != "", F.when(at.isNull(), start).otherwise(cut))


def search(df: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """The best documents of one query: score, snippet; ties by document_id.

    The query's tokens are literals, so scoring needs no index and no shuffle: one scan, k rows per task.
    A token that the query repeats scores again.
    """
    tokens = query_tokens(query)
    weights = Counter(tokens)
    asked = F.array(*[F.lit(t) for t in weights]).cast("array<string>")
    weight = F.create_map(*[x for t, n in weights.items() for x in (F.lit(t), F.lit(float(n)))]) if weights else F.create_map().cast("map<string,double>")
    # the document's tokens are named once, so they are read once
    score = F.aggregate(F.array_intersect(document_tokens(df), asked), F.lit(0.0), lambda s, t: s + weight[t])
    hits = df.withColumn("score", score).where(F.col("score") > 0)
    top = hits.orderBy(F.desc("score"), "document_id").limit(limit)
    return top.withColumn("snippet", snippet(F.coalesce(F.col("text"), F.lit("")), tokens))


def search_boosted(df: DataFrame, query: str, boosts: Mapping[str, float], limit: int = 10) -> DataFrame:
    """The best documents where each field (title, text, url and so on) counts its own weight for every query token in it.

    The fields' scores are added up; a missing field or a null scores nothing; ties by document_id.
    """
    weights = Counter(query_tokens(query))
    asked = F.array(*[F.lit(t) for t in weights]).cast("array<string>")
    weight = F.create_map(*[x for t, n in weights.items() for x in (F.lit(t), F.lit(float(n)))]) if weights else F.create_map().cast("map<string,double>")
    of = lambda c: F.array_intersect(words(F.lower(F.coalesce(F.col(c), F.lit("")))), asked)
    parts = [F.aggregate(of(c), F.lit(0.0), lambda s, t: s + weight[t]) * F.lit(float(b)) for c, b in boosts.items() if c in df.columns]
    hits = df.withColumn("score", sum(parts, F.lit(0.0))).where(F.col("score") > 0)
    return hits.orderBy(F.desc("score"), "document_id").limit(limit)


def postings(df: DataFrame) -> DataFrame:
    """The inverted index: distinct (token, document_id) of the current documents."""
    return df.select(F.explode(document_tokens(df)).alias("token"), "document_id").distinct()


def search_many(index: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """(query_id, document_id, score, rank) for many queries (query_id, query) over ``postings``.

    Query tokens are counted first, so a repeated token weighs its count in one join row; the postings
    of hot tokens are spread, and scores are summed before the shuffle.
    """
    asked = queries.select("query_id", F.explode(words(F.lower("query"))).alias("token")).groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("w"))
    scores = salted_join(index, asked, ["token"], "inner").groupBy("query_id", "document_id").agg(F.sum("w").cast("double").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "document_id")
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)
