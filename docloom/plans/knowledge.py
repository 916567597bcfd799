"""The flagship flow from raw documents to retrieval hits: nine operators of the registry as one pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators import documents as D
from docloom.plans.operators import default_registry
from docloom.plans.execution import Executor, Run
from docloom.plans.pipeline import Pipeline, Step, compile_plan
from docloom.storage import shared_folder


def knowledge_steps(query: str, rules: list[D.Rule], k: int, digits: int | None, order: str) -> Pipeline:
    """Normalize, enrich, dedup, compliance, chunk, provenance, embed, upsert, retrieve.

    The enriched documents and the envelopes are results of their own, so both are written; with the
    chunks beside their envelopes, nothing before them is computed twice.
    """
    also = () if order == "document_id" else (order,)
    parents = F.array(F.col("document_id").cast("string"))
    steps = (
        Step("normalize", "normalize", {"documents": "$pipeline.documents"}),
        Step("enrich", "enrich", {"documents": "normalize.result"}, {"drop": ("text",)}, checkpoint=True),
        Step("dedup", "dedup", {"documents": "enrich.result"}, {"order": order, "text": "enriched_text"}),
        Step("compliance", "compliance", {"documents": "dedup.result"}, {"rules": tuple(rules)}),
        Step("chunk", "chunk", {"documents": "compliance.result"}, {"keep": ("metadata", *also)}),
        Step("payload", "chunk_payload", {"chunks": "chunk.result"}),
        Step("provenance", "provenance", {"rows": "payload.result"}, {"resource_type": "ChunkPayload", "schema_version": "1.0", "payload": ["chunk_id", "document_id", "text", "summary"], "parents": parents}, checkpoint=True),
        Step("embed", "embed", {"items": "provenance.result"}),
        Step("records", "records", {"chunks": "embed.result"}, {"keep": also}),
        Step("upsert", "upsert", {"records": "records.result"}, {"order": order}),
        Step("retrieve", "retrieve", {"records": "upsert.result"}, {"query": query, "k": k, "digits": digits}),
    )
    return Pipeline("knowledge", steps, ("documents",))


def knowledge_run(docs: DataFrame, query: str, rules: list[D.Rule], k: int = 5, digits: int | None = 6, order: str = "document_id") -> Run:
    """A finished run; ``results`` holds the output of every step. A failed step raises.

    ``order``: the first of equal texts stays, and the last record of an id (equal orders go by a hash of the record).
    """
    spark, registry = docs.sparkSession, default_registry()
    plan = compile_plan(knowledge_steps(query, rules, k, digits, order), registry)
    run = Executor(registry, spark, f"{shared_folder(spark)}/knowledge").execute(plan, {"documents": docs})
    if run.outcome != "succeeded":
        raise RuntimeError(f"the pipeline {run.outcome}: {run.errors}")
    return run


def knowledge(docs: DataFrame, query: str, rules: list[D.Rule], k: int = 5, digits: int | None = 6, order: str = "document_id") -> DataFrame:
    """The k best chunks for a query."""
    return knowledge_run(docs, query, rules, k, digits, order).results["retrieve"]
