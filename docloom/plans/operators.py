"""The default registry: every batch operator under its capability's name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators import documents as D
from docloom.operators import search as S
from docloom.operators import vectors as V
from docloom.operators import web as W
from docloom.plans.pipeline import Registry


def _text_from(documents: DataFrame, column: str) -> DataFrame:
    """The documents with ``column`` as their text."""
    return documents if column == "text" else documents.drop("text").withColumnRenamed(column, "text")


def default_registry() -> Registry:
    r = Registry()
    r.register("normalize", lambda documents, **k: D.normalize(documents, D.NormalizeSettings(**k)).drop("text").withColumnRenamed("normalized_text", "text"))
    r.register("enrich", lambda documents, drop=(), **k: D.enrich(documents, D.EnrichSettings(**k)).drop(*drop))
    r.register("dedup", lambda documents, order="document_id", text="text", **k: D.Deduplicated(_text_from(documents, text), order, D.DedupSettings(**k)).documents())
    r.register("compliance", lambda documents, rules=(), only=True: D.check(documents, list(rules)).where("compliant") if only else D.check(documents, list(rules)))
    r.register("chunk", lambda documents, keep=("metadata",), **k: D.chunk(documents, D.ChunkSettings(**k), keep))
    r.register("analyze", lambda documents, **k: D.analyze(documents, **k))
    r.register("diff", lambda pairs, **k: D.diff(pairs, **k))
    r.register("embed", lambda items, **k: V.embed(items, **k))
    r.register("records", lambda chunks, namespace="default", keep=(): chunks.select(F.col("chunk_id").alias("record_id"), F.lit(namespace).alias("namespace"), F.col("values").alias("vector"), "document_id", "chunk_id", "text", "metadata", *keep))
    r.register("upsert", lambda records, order: V.upsert(records, order))
    r.register("retrieve", lambda records, query, k=5, **o: V.retrieve(records, query, k, **o))
    r.register("search", lambda documents, query, limit=10: S.search(documents, query, limit))
    r.register("scrape", lambda pages, **k: W.scrape(pages, **k))
    r.register("monitor", lambda observations, **k: W.monitor(observations, **k))
    r.register("archive", lambda records, **k: W.archive_segments(records, **k))
    r.register("provenance", lambda rows, **k: W.envelopes(rows, **k))
    r.register("chunk_payload", lambda chunks, summary_chars=24: chunks.withColumn("summary", F.substring("text", 1, summary_chars)))
    return r
