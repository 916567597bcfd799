"""A declarative pipeline of operators, compiled to a plan.

Steps are DataFrame functions; a step's inputs are bound to the outputs of other steps or to the
pipeline's inputs. ``docloom.plans.execution`` runs plans.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass, field
from importlib.metadata import entry_points
from typing import Any

STATES = ("pending", "running", "succeeded", "failed", "skipped", "cancelled")
ON_ERROR = ("abort", "continue", "fallback", "skip")


class PlanError(ValueError):
    """The pipeline cannot be planned."""


@dataclass(frozen=True)
class Retry:
    max_attempts: int = 1
    backoff: float = 0.0
    multiplier: float = 2.0
    max_delay: float = 60.0

    def delay(self, attempt: int) -> float:
        """The pause before this attempt (the first has none)."""
        return 0.0 if attempt < 2 else min(self.max_delay, self.backoff * self.multiplier ** (attempt - 2))


@dataclass(frozen=True)
class Step:
    step_id: str
    operator: str
    inputs: Mapping[str, str] = field(default_factory=dict)
    params: Mapping[str, Any] = field(default_factory=dict)
    depends_on: tuple[str, ...] = ()
    condition: str | None = None
    retry: Retry = Retry()
    timeout: float | None = None
    fallbacks: tuple[str, ...] = ()
    on_error: str = "abort"
    checkpoint: bool = False
    compensation: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.on_error not in ON_ERROR:
            raise PlanError(f"on_error is one of {ON_ERROR}")


@dataclass(frozen=True)
class Pipeline:
    pipeline_id: str
    steps: tuple[Step, ...]
    inputs: tuple[str, ...] = ()
    version: str = "1"

    @classmethod
    def from_mapping(cls, raw: Mapping[str, Any]) -> Pipeline:
        """From a plain mapping, as files hold it."""
        try:
            steps = []
            for s in raw["steps"]:
                s = dict(s)
                if "retry" in s:
                    s["retry"] = Retry(**s["retry"])
                for k in ("depends_on", "fallbacks", "compensation"):
                    if k in s:
                        s[k] = tuple(s[k])
                steps.append(Step(**s))
            return cls(raw["pipeline_id"], tuple(steps), tuple(raw.get("inputs", ())), str(raw.get("version", "1")))
        except (KeyError, TypeError) as e:
            raise PlanError(f"malformed pipeline: {e}") from e


def definition(pipeline: Pipeline) -> str:
    """The pipeline as indented JSON with sorted keys; parameters that JSON lacks come as text."""
    return json.dumps(asdict(pipeline), sort_keys=True, indent=2, default=repr)


def content_hash(pipeline: Pipeline) -> str:
    return hashlib.sha256(definition(pipeline).encode()).hexdigest()


class Registry:
    """Named operators with versions and priorities; the highest (priority, version, name) serves a capability."""

    def __init__(self) -> None:
        self._all: dict[str, tuple[str, int, str, Callable[..., Any]]] = {}
        self._frozen = False

    def freeze(self) -> Registry:
        """No operator is added from here on."""
        self._frozen = True
        return self

    def discover(self, group: str = "docloom.operators") -> list[str]:
        """Registers what installed packages offer under the entry-point group; an offer is a function of the registry."""
        before = set(self._all)
        for point in sorted(entry_points(group=group), key=lambda e: e.name):
            point.load()(self)
        return sorted(set(self._all) - before)

    def register(self, name: str, run: Callable[..., Any], capability: str | None = None, priority: int = 0, version: str = "1.0") -> None:
        if self._frozen:
            raise PlanError("the registry is frozen")
        if name in self._all:
            raise PlanError(f"operator {name!r} is registered already")
        if not callable(run) or not all(x.isdigit() for x in version.split(".")):
            raise PlanError(f"operator {name!r} needs a function and a version of numbers")
        self._all[name] = (capability or name, priority, version, run)

    def resolve(self, name: str) -> str:
        """An operator's own name, or the best provider of a capability."""
        if name in self._all:
            return name
        able = [(p, tuple(int(x) for x in v.split(".")), n) for n, (c, p, v, _) in self._all.items() if c == name]
        if not able:
            raise PlanError(f"unknown operator {name!r}")
        return max(able)[2]

    def run(self, name: str) -> Callable[..., Any]:
        return self._all[name][3]

    def describe(self, name: str) -> dict[str, Any]:
        c, p, v, _ = self._all[name]
        return {"name": name, "capability": c, "priority": p, "version": v}

    def listing(self) -> list[dict[str, Any]]:
        return [self.describe(n) for n in sorted(self._all)]


@dataclass(frozen=True)
class Plan:
    pipeline: Pipeline
    order: tuple[str, ...]
    levels: tuple[tuple[str, ...], ...]
    providers: Mapping[str, tuple[str, ...]]
    dependencies: Mapping[str, tuple[str, ...]]
    fingerprint: str

    @property
    def capabilities(self) -> tuple[str, ...]:
        """What the plan asks of the registry, each once, in order."""
        return tuple(sorted({s.operator for s in self.pipeline.steps} | {f for s in self.pipeline.steps for f in s.fallbacks}))


def binding_source(binding: str, step_ids: set[str]) -> tuple[str | None, str]:
    """('step', output) of ``step.output``; (None, name) of ``$pipeline.name``."""
    owner, _, name = binding.partition(".")
    if owner == "$pipeline":
        return None, name
    if owner not in step_ids:
        raise PlanError(f"{binding!r} names no step")
    return owner, name or "result"


def compile_plan(pipeline: Pipeline, registry: Registry) -> Plan:
    """Checks ids, operators, fallbacks and bindings; orders the steps (ties by id); fingerprints the result."""
    ids = [s.step_id for s in pipeline.steps]
    if len(set(ids)) != len(ids):
        raise PlanError("step ids must be unique")
    known = set(ids)
    providers, needs = {}, {}
    for s in pipeline.steps:
        providers[s.step_id] = tuple(dict.fromkeys([registry.resolve(s.operator), *map(registry.resolve, s.fallbacks)]))
        own = set()
        for d in s.depends_on:
            if d not in known:
                raise PlanError(f"{s.step_id} depends on unknown {d!r}")
            own.add(d)
        for b in s.inputs.values():
            owner, name = binding_source(b, known)
            if owner is None and name not in pipeline.inputs:
                raise PlanError(f"{s.step_id} reads undeclared input {name!r}")
            if owner is not None:
                own.add(owner)
        needs[s.step_id] = tuple(sorted(own))
    order, level = [], {}
    waiting = {k: set(v) for k, v in needs.items()}
    ready = sorted(k for k, v in waiting.items() if not v)
    while ready:
        now = ready.pop(0)
        order.append(now)
        level[now] = 1 + max((level[d] for d in needs[now]), default=-1)
        freed = sorted(k for k, v in waiting.items() if now in v and v == {now})
        for k, v in waiting.items():
            v.discard(now)
        ready += freed
    if len(order) != len(ids):
        raise PlanError("the steps depend on each other in a circle")
    levels = tuple(tuple(sorted(k for k in order if level[k] == n)) for n in range(max(level.values(), default=-1) + 1))
    shape = {
        "pipeline": pipeline.pipeline_id,
        "version": pipeline.version,
        "steps": [{"id": s.step_id, "providers": [registry.describe(p) for p in providers[s.step_id]], "inputs": dict(sorted(s.inputs.items())), "params": {k: repr(v) for k, v in sorted(s.params.items())}, "needs": needs[s.step_id], "if": s.condition, "on_error": s.on_error} for s in sorted(pipeline.steps, key=lambda s: s.step_id)],
    }
    digest = hashlib.sha256(json.dumps(shape, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    return Plan(pipeline, tuple(order), levels, providers, needs, digest)
