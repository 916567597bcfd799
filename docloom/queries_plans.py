"""Registered queries over pipeline runs, with their SQL: what a run leaves in its step, event and lineage tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.plans.conditions import ConditionError, evaluate
from docloom.plans.execution import Executor, Run
from docloom.plans.pipeline import Pipeline, Plan, Registry, Retry, Step, compile_plan, content_hash, definition
from docloom.storage import shared_folder, table


def _broken(rows: DataFrame) -> DataFrame:
    """Plans well and fails as a Spark job."""
    return rows.withColumn("n", F.raise_error(F.lit("broken")).cast("long"))


def _registry(healed: bool = False) -> Registry:
    calls = {"flaky": 0}

    def flaky(documents: DataFrame) -> DataFrame:
        calls["flaky"] += 1
        rows = documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
        return rows if calls["flaky"] > 2 else _broken(rows)

    r = Registry()
    r.register("with_text", lambda documents: documents.where("text is not null"))
    r.register("flaky", flaky)
    r.register("per_language", lambda documents: documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    r.register("broken", lambda documents: _broken(documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))))
    r.register("fragile", lambda rows: rows if healed else _broken(rows))
    r.register("total", lambda rows: rows.agg(F.sum("n").alias("n")))
    return r.freeze()


_STEPS = (
    Step("load", "with_text", {"documents": "$pipeline.documents"}),
    Step("a_retried", "flaky", {"documents": "load.result"}, retry=Retry(3)),
    Step("b_replaced", "broken", {"documents": "load.result"}, fallbacks=("per_language",)),
    Step("c_doomed", "broken", {"documents": "load.result"}, on_error="continue"),
    Step("d_after_doomed", "total", {"rows": "c_doomed.result"}),
    Step("e_gated", "total", {"rows": "a_retried.result"}, condition="wanted == 'yes'"),
    Step("f_total", "total", {"rows": "b_replaced.result"}, checkpoint=True),
)


def _run(spark: SparkSession, sf: str) -> tuple[Executor, Run]:
    registry = _registry()
    plan = compile_plan(Pipeline("policies", _STEPS, ("documents", "wanted")), registry)
    ex = Executor(registry, spark, f"{shared_folder(spark)}/plans-{uuid.uuid4().hex}")
    return ex, ex.execute(plan, {"documents": table(spark, sf, "documents"), "wanted": "no"})


def pipeline_steps(spark, sf):
    """The end state and retries of every step under retry, fallback, continue, skip and condition."""
    ex, _ = _run(spark, sf)
    return ex.store.table("steps").select("step_id", "state", "retries", F.col("error").isNotNull().alias("has_error"))


def pipeline_events(spark, sf):
    """How often each event befell each step."""
    ex, _ = _run(spark, sf)
    return ex.store.table("events").groupBy(F.coalesce("step_id", F.lit("run")).alias("step_id"), "event").agg(F.count(F.lit(1)).alias("n"))


def pipeline_lineage(spark, sf):
    """Which provider made each result, out of which steps."""
    ex, _ = _run(spark, sf)
    return ex.store.table("lineage").select("step_id", "provider", F.array_join("parents", ",").alias("parents"))


def pipeline_result(spark, sf):
    """The result of the last step, computed behind a replaced provider."""
    _, run = _run(spark, sf)
    return run.results["f_total"]


_FRAGILE = (
    Step("count", "per_language", {"documents": "$pipeline.documents"}, checkpoint=True),
    Step("fragile", "fragile", {"rows": "count.result"}, on_error="continue"),
)


def _plan(healed: bool) -> tuple[Registry, Plan]:
    registry = _registry(healed)
    return registry, compile_plan(Pipeline("fragile", _FRAGILE, ("documents",)), registry)


def _letter(spark: SparkSession, sf: str) -> tuple[Executor, Run]:
    registry, plan = _plan(False)
    ex = Executor(registry, spark, f"{shared_folder(spark)}/plans-{uuid.uuid4().hex}")
    return ex, ex.execute(plan, {"documents": table(spark, sf, "documents")})


def pipeline_replayed(spark, sf):
    """A dead-lettered run, replayed by its id by an executor that knows nothing but the folder."""
    ex, run = _letter(spark, sf)
    registry, plan = _plan(True)
    other = Executor(registry, spark, ex.folder)
    return other.replay(run.run_id, {"documents": table(spark, sf, "documents")}, plan).results["fragile"]


def pipeline_dead_letters(spark, sf):
    """The letters a failed run leaves: pipeline, failed steps and retries."""
    ex, _ = _letter(spark, sf)
    raw = spark.read.schema("run_id string, pipeline_id string, retries int, errors map<string,string>").json(f"{ex.folder}/letters")
    return raw.select("pipeline_id", F.array_join(F.map_keys("errors"), ",").alias("failed"), "retries")


def provider_choice(spark, sf):
    """Which operator serves each capability: the highest priority, then version, then name."""
    r = Registry()
    offers = (("sum-a", "sum", 1, "1.0"), ("sum-b", "sum", 5, "1.2"), ("sum-c", "sum", 5, "1.10"), ("join-x", "join", 0, "2.0"), ("join-y", "join", 0, "2.0"))
    for name, capability, priority, version in offers:
        r.register(name, len, capability, priority, version)
    return spark.createDataFrame([(c, r.resolve(c)) for c in ("sum", "join", "sum-a")], "capability string, provider string")


_CONDITIONS = ("pages > 3 and lang == 'de'", "pages > 3 or unknown", "exists(unknown)", "not (lang == 'en' or pages < 5)", "1 < pages < 9", "lang in names", "pages + 1 > 2", "len(lang) > 1", "lang.__class__")


def condition_values(spark, sf):
    """What conditions give over the same values; a refused one gives null. Both sides of and/or are always read."""
    rows = []
    for c in _CONDITIONS:
        try:
            rows.append((c, evaluate(c, {"pages": 5, "lang": "de", "names": ["de"]})))
        except ConditionError:
            rows.append((c, None))
    return spark.createDataFrame(rows, "condition string, value boolean")


def plan_capabilities(spark, sf):
    """What the policy pipeline asks of the registry, each once."""
    plan = compile_plan(Pipeline("policies", _STEPS, ("documents", "wanted")), _registry())
    return spark.createDataFrame([(c,) for c in plan.capabilities], "capability string")


def plan_definition(spark, sf):
    """A pipeline's definition as text, and the digest that names this version of it."""
    p = Pipeline("tiny", (Step("count", "per_language", {"documents": "$pipeline.documents"}),), ("documents",), "7")
    return spark.createDataFrame([(p.pipeline_id, p.version, content_hash(p), len(json.loads(definition(p))["steps"]))], "pipeline_id string, version string, content_hash string, steps int")


QUERIES = {f.__name__: f for f in (pipeline_steps, pipeline_events, pipeline_lineage, pipeline_result, pipeline_replayed, pipeline_dead_letters, provider_choice, condition_values, plan_capabilities, plan_definition)}
SQL = {
    "pipeline_steps": """select * from (values ('load', 'succeeded', 0, false), ('a_retried', 'succeeded', 2, false), ('b_replaced', 'succeeded', 0, false),
  ('c_doomed', 'failed', 0, true), ('d_after_doomed', 'skipped', 0, false), ('e_gated', 'skipped', 0, false), ('f_total', 'succeeded', 0, false)) t(step_id, state, retries, has_error)""",
    "pipeline_events": """select step_id, event, n::bigint as n from (values ('load', 'started', 1), ('load', 'succeeded', 1),
  ('a_retried', 'started', 1), ('a_retried', 'attempt_failed', 2), ('a_retried', 'succeeded', 1), ('b_replaced', 'started', 1), ('b_replaced', 'attempt_failed', 1), ('b_replaced', 'succeeded', 1),
  ('c_doomed', 'started', 1), ('c_doomed', 'attempt_failed', 1), ('c_doomed', 'failed', 1), ('e_gated', 'skipped', 1), ('f_total', 'started', 1), ('f_total', 'succeeded', 1), ('run', 'dead_lettered', 1)) t(step_id, event, n)""",
    "pipeline_lineage": "select * from (values ('load', 'with_text', ''), ('a_retried', 'flaky', 'load'), ('b_replaced', 'per_language', 'load'), ('f_total', 'total', 'b_replaced')) t(step_id, provider, parents)",
    "pipeline_result": "select count(*) as n from documents where text is not null",
    "pipeline_replayed": "select lang, count(*) as n from documents group by lang",
    "pipeline_dead_letters": "select 'fragile' as pipeline_id, 'fragile' as failed, 0::int as retries",
    "provider_choice": "select * from (values ('sum', 'sum-c'), ('join', 'join-y'), ('sum-a', 'sum-a')) t(capability, provider)",
    "condition_values": """select condition, value::boolean as value from (values ('pages > 3 and lang == ''de''', true), ('pages > 3 or unknown', null), ('exists(unknown)', false), ('not (lang == ''en'' or pages < 5)', true),
  ('1 < pages < 9', true), ('lang in names', null), ('pages + 1 > 2', null), ('len(lang) > 1', null), ('lang.__class__', null)) t(condition, value)""",
    "plan_capabilities": "select * from (values ('broken'), ('flaky'), ('per_language'), ('total'), ('with_text')) t(capability)",
    "plan_definition": """select 'tiny' as pipeline_id, '7' as version, 1::int as steps, sha256('{
  "inputs": [
    "documents"
  ],
  "pipeline_id": "tiny",
  "steps": [
    {
      "checkpoint": false,
      "compensation": [],
      "condition": null,
      "depends_on": [],
      "fallbacks": [],
      "inputs": {
        "documents": "$pipeline.documents"
      },
      "on_error": "abort",
      "operator": "per_language",
      "params": {},
      "retry": {
        "backoff": 0.0,
        "max_attempts": 1,
        "max_delay": 60.0,
        "multiplier": 2.0
      },
      "step_id": "count",
      "timeout": null
    }
  ],
  "version": "7"
}') as content_hash""",
}
