import threading
import time

import pytest
from pyspark.sql import functions as F

from docloom.plans.operators import default_registry
from docloom.plans import middleware as M
from docloom.plans.components import ComponentError, Components, Lifecycle
from docloom.plans.execution import Executor, Run, RunStore
from docloom.plans.pipeline import Pipeline, PlanError, Registry, Retry, Step, compile_plan, content_hash, definition


def registry(**more):
    r = Registry()
    r.register("one", lambda: 1)
    r.register("inc", lambda x, by=1: x + by)
    r.register("fail", lambda **k: 1 / 0)
    for k, v in more.items():
        r.register(k, v)
    return r


def run(steps, reg=None, inputs=None, names=(), **kw):
    reg = reg or registry()
    ex = Executor(reg, sleep=lambda s: None, **kw)
    return ex, ex.execute(compile_plan(Pipeline("p", tuple(steps), names), reg), inputs)


def test_order_levels_and_fingerprint():
    steps = (Step("c", "inc", {"x": "a.result"}), Step("b", "inc", {"x": "$pipeline.n"}), Step("a", "one"))
    plan = compile_plan(Pipeline("p", steps, ("n",)), registry())
    assert plan.order == ("a", "b", "c")
    assert plan.levels == (("a", "b"), ("c",))
    assert plan.fingerprint == compile_plan(Pipeline("p", steps[::-1], ("n",)), registry()).fingerprint
    assert plan.fingerprint != compile_plan(Pipeline("q", steps, ("n",)), registry()).fingerprint


@pytest.mark.parametrize(
    "steps",
    [
        (Step("a", "inc", {"x": "b.result"}), Step("b", "inc", {"x": "a.result"})), (Step("a", "one"), Step("a", "one")), (Step("a", "nobody"),), (Step("a", "inc", {"x": "$pipeline.z"}),), (Step("a", "inc", {"x": "z.result"}),), (Step("a", "one", depends_on=("z",)),), (Step("a", "one", fallbacks=("nobody",)),),
    ],
)
def test_bad_plans(steps):
    with pytest.raises(PlanError):
        compile_plan(Pipeline("p", steps), registry())


def test_bindings_and_conditions():
    _, r = run([Step("a", "one"), Step("b", "inc", {"x": "a.result"}, {"by": 5}, condition="x == 1"), Step("c", "inc", {"x": "b.result"}, condition="x == 1"), Step("d", "inc", {"x": "c.result"})])
    assert r.results["b"] == 6
    assert (r.states["c"], r.states["d"], r.outcome) == ("skipped", "skipped", "succeeded")
    with pytest.raises(PlanError):
        run([Step("a", "one")], inputs={"n": 1})


@pytest.mark.parametrize(("policy", "states", "outcome"), [("abort", ("failed", "cancelled", "cancelled"), "failed"), ("continue", ("failed", "succeeded", "skipped"), "partially_succeeded"), ("skip", ("failed", "succeeded", "skipped"), "partially_succeeded")])
def test_on_error(policy, states, outcome):
    ex, r = run([Step("a", "fail", on_error=policy, compensation=("undo",)), Step("b", "one"), Step("c", "one", depends_on=("a",))], max_concurrency=1)
    assert tuple(r.states[k] for k in "abc") == states
    assert r.outcome == outcome
    assert any(e["event"] == "compensate" for e in r.events)
    assert r.run_id in ex.dead_letters


def test_retry_fallback_and_replay():
    left = [2]

    def flaky():
        left[0] -= 1
        if left[0] >= 0:
            raise OSError("again")
        return "ok"

    reg = registry(flaky=flaky)
    _, r = run([Step("a", "flaky", retry=Retry(3))], reg)
    assert (r.results["a"], r.retries["a"]) == ("ok", 2)
    _, r = run([Step("a", "fail", fallbacks=("one",), retry=Retry(2))], reg)
    assert (r.results["a"], r.lineage[0]["provider"]) == (1, "one")
    left[0] = 1
    ex, r = run([Step("x", "one"), Step("a", "flaky", depends_on=("x",))], reg)
    assert r.outcome == "partially_succeeded"
    again = ex.replay(r.run_id)
    assert (again.outcome, again.states["a"], again.run_id) == ("succeeded", "succeeded", r.run_id)
    with pytest.raises(KeyError):
        ex.replay(r.run_id)
    assert [Retry(5, 1.0, 2.0, 3.0).delay(i) for i in range(1, 5)] == [0, 1, 2, 3]


def test_timeout_cancel_and_listener():
    reg = registry(slow=lambda: time.sleep(1.5))
    _, r = run([Step("a", "slow", timeout=0.1)], reg)
    assert "StepTimeout" in r.errors["a"]

    def listen(e):
        raise RuntimeError

    _, r = run([Step("a", "one")], on_event=listen)
    assert r.outcome == "succeeded"
    ex = Executor(registry())
    plan = compile_plan(Pipeline("p", (Step("a", "one"),)), registry())
    mine = Run("r1", plan, {"a": "pending"})
    ex.cancel("r1")
    assert ex.execute(plan, {}, mine).outcome == "cancelled"


def test_capabilities_choose_the_best_provider():
    reg = Registry()
    reg.register("slow-sum", lambda: "s", "sum", 1)
    reg.register("fast-sum", lambda: "f", "sum", 5)
    assert reg.resolve("sum") == "fast-sum"
    with pytest.raises(PlanError):
        reg.register("fast-sum", lambda: 1)


def test_mapping():
    p = Pipeline.from_mapping({"pipeline_id": "p", "steps": [{"step_id": "a", "operator": "one", "retry": {"max_attempts": 2}, "fallbacks": ["inc"]}]})
    assert p.steps[0].retry.max_attempts == 2
    with pytest.raises(PlanError):
        Pipeline.from_mapping({"steps": []})


def test_dataframe_pipeline_with_checkpoint_and_resume(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Alpha beta gamma", None), (2, "alpha  BETA gamma", None)], "document_id long, text string, metadata map<string,string>")
    reg = default_registry()
    steps = (Step("n", "normalize", {"documents": "$pipeline.docs"}), Step("d", "dedup", {"documents": "n.result"}, checkpoint=True), Step("c", "chunk", {"documents": "d.result"}, {"chunk_size": 2, "overlap": 1}), Step("boom", "compliance", {"documents": "c.nothing"}, {"rules": 5}))
    plan = compile_plan(Pipeline("k", steps, ("docs",)), reg)
    ex = Executor(reg, spark, f"file://{tmp_path}")
    r = ex.execute(plan, {"docs": docs})
    assert [x.text for x in r.results["c"].orderBy("chunk_index").collect()] == ["alpha beta", "beta gamma"]
    assert r.states["boom"] == "failed"
    again = ex.resume(r, {"docs": docs})
    assert again.results["d"].count() == 1
    assert [x["step_id"] for x in again.lineage] == ["d", "n", "c"] or {x["step_id"] for x in again.lineage} == {"n", "d", "c"}


def test_steps_run_side_by_side_up_to_the_bound():
    gate, most, now, lock = threading.Barrier(3, timeout=10), [0], [0], threading.Lock()

    def meet():
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        gate.wait()  # only three at once get through
        with lock:
            now[0] -= 1
        return 1

    _, r = run([Step(f"s{i}", "meet") for i in range(6)], registry(meet=meet), max_concurrency=3)
    assert (r.outcome, most[0]) == ("succeeded", 3)


def test_a_failing_spark_job_is_inside_the_attempt(spark, tmp_path):
    calls = []

    def bad():
        calls.append(1)
        return spark.range(3).select(F.raise_error(F.lit("no")).cast("long").alias("x"))

    reg = registry(bad=bad, good=lambda: spark.range(4))
    ex = Executor(reg, spark, f"file://{tmp_path}", sleep=lambda s: None)
    plan = compile_plan(Pipeline("p", (Step("a", "bad", retry=Retry(3), on_error="continue", checkpoint=True), Step("b", "bad", fallbacks=("good",)), Step("c", "one")), ()), reg)
    r = ex.execute(plan)
    assert r.states == {"a": "failed", "b": "succeeded", "c": "succeeded"}
    assert (r.results["b"].count(), r.retries["a"], len(calls), r.outcome) == (4, 2, 4, "partially_succeeded")
    assert ex.store.letters() == [r.run_id]


def test_timeout_covers_the_job_and_interrupts_it(spark, tmp_path):
    slow = lambda: spark.range(200).repartition(2).select(F.expr("java_method('java.lang.Thread', 'sleep', 50L)").alias("x"))
    reg = registry(slow=slow)
    ex = Executor(reg, spark, f"file://{tmp_path}")
    start = time.time()
    r = ex.execute(compile_plan(Pipeline("p", (Step("a", "slow", timeout=1.0),)), reg))
    assert ("StepTimeout" in r.errors["a"] or "cancel" in r.errors["a"].lower()) and time.time() - start < 15


def test_runs_outlive_their_executor(spark, tmp_path):
    left = [1]

    def later(x):
        left[0] -= 1
        return 1 / 0 if left[0] >= 0 else x + 1

    reg = registry(later=later, rows=lambda: spark.range(5))
    plan = compile_plan(Pipeline("p", (Step("v", "one"), Step("t", "rows", checkpoint=True), Step("l", "later", {"x": "v.result"}))), reg)
    folder = f"file://{tmp_path}"
    first = Executor(reg, spark, folder, max_concurrency=1).execute(plan)
    assert first.outcome == "partially_succeeded"
    other = Executor(reg, spark, folder)
    again = other.resume_id(first.run_id, plan)
    assert (again.outcome, again.results["l"], again.results["t"].count()) == ("succeeded", 2, 5)
    assert again.states["v"] == "succeeded" and [e["event"] for e in again.events].count("started") == 4
    with pytest.raises(PlanError):
        other.resume_id(first.run_id, compile_plan(Pipeline("q", (Step("v", "one"),)), reg))
    store = RunStore(spark, folder)
    assert store.snapshots().select("outcome").first()[0] == "succeeded"
    assert {r.step_id for r in store.table("lineage").collect()} == {"v", "t", "l"}
    store.pop_letter(first.run_id)
    with pytest.raises(KeyError):
        store.pop_letter(first.run_id)
    with pytest.raises(KeyError):
        store.load("nobody", plan)


def test_middleware_order_and_kinds():
    seen, slept, tracer = [], [], M.Tracer()
    mark = lambda name, **k: M.Middleware(name, lambda a, go: (seen.append(name), go())[1], **k)
    items = [mark("x", after=("y",)), mark("y"), mark("z", priority=9), mark("w", before=("z",)), tracer.middleware()]
    assert [m.name for m in M.ordered(items)] == ["tracing", "w", "z", "y", "x"]
    _, r = run([Step("a", "one"), Step("b", "fail", on_error="continue")], middleware=[*items, M.logs()], max_concurrency=1)
    assert seen[:4] == ["w", "z", "y", "x"]
    assert [(s["step_id"], s["succeeded"]) for s in tracer.spans] == [("a", True), ("b", False)]
    for bad in ([mark("p", after=("q",)), mark("q", after=("p",))], [mark("p"), mark("p")]):
        with pytest.raises(ValueError):
            M.ordered(bad)
    at = M.Attempt("r", "s", "p", 1)
    left = [2, 1, 0]
    assert M.chain([M.retries(3, 0.5, sleep=slept.append)], at, lambda: 7 if left.pop() == 2 else 1 / 0) == 7 and slept == [0.5, 0.5]
    with pytest.raises(ZeroDivisionError):
        M.chain([M.retries(2, sleep=slept.append)], at, lambda: 1 / 0)
    limit = M.rate_limits(1.0, 1, clock=lambda: 5.0, sleep=slept.append)
    slept.clear()
    assert [M.chain([limit], at, lambda: 1) for _ in range(3)] == [1, 1, 1] and slept == [1.0, 2.0]
    with pytest.raises(TimeoutError):
        M.chain([M.deadline(0.05)], at, lambda: time.sleep(0.5))


def test_signals():
    s, got = M.Signals(), []
    s.connect("x", lambda n: got.append(n))
    s.connect("x", lambda n: 1 / 0)
    assert len(s.send("x", n=1)) == 1 and got == [1]
    s.connect("x", lambda n: 1 / 0, critical=True)
    with pytest.raises(ZeroDivisionError):
        s.send("x", n=2)
    assert s.send("other") == []


def test_components_and_lifecycle():
    closed, c = [], Components()
    c.provide("base", lambda: [1], kind=list, teardown=lambda x: closed.append("base"))
    c.provide("user", lambda b: {"b": b}, {"b": "base"}, teardown=lambda x: closed.append("user"))
    c.provide("odd", lambda: 1, kind=str)
    c.provide("p", lambda q: q, {"q": "q"})
    c.provide("q", lambda p: p, {"p": "p"})
    assert c.get("user")["b"] is c.get("base")
    for bad in ("odd", "p", "nobody"):
        with pytest.raises(ComponentError):
            c.get(bad)
    with pytest.raises(ComponentError):
        c.provide("base", list)
    c.close()
    assert closed == ["user", "base"]
    entered = []
    life = Lifecycle({"validated": lambda: entered.append(1)})
    life.enter("validated")
    assert entered == [1]
    with pytest.raises(ComponentError):
        life.enter("activated")


def test_registry_is_checked_frozen_and_discovers():
    reg = registry()
    for bad in (("n", 5, {}), ("n", lambda: 1, {"version": "x"})):
        with pytest.raises(PlanError):
            reg.register(bad[0], bad[1], **bad[2])
    assert reg.discover("no.such.group") == []
    with pytest.raises(PlanError):
        reg.freeze().register("late", lambda: 1)


def test_definition_capabilities_and_hash():
    a = Pipeline("p", (Step("b", "one", fallbacks=("inc",)), Step("a", "one")))
    assert compile_plan(a, registry()).capabilities == ("inc", "one")
    assert definition(a).startswith("{") and content_hash(a) == content_hash(Pipeline("p", a.steps))
    assert content_hash(a) != content_hash(Pipeline("p", a.steps[:1]))
