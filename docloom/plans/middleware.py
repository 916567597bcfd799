"""Functions around every attempt of a step, and signals."""

from __future__ import annotations

import logging
import threading
import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from docloom.operators.ops import TokenBucket


@dataclass(frozen=True)
class Attempt:
    run_id: str
    step_id: str
    provider: str
    number: int


@dataclass(frozen=True)
class Middleware:
    """``call(attempt, proceed)`` returns what the attempt is to give, usually ``proceed()``."""

    name: str
    call: Callable[[Attempt, Callable[[], Any]], Any]
    priority: int = 0
    before: tuple[str, ...] = ()
    after: tuple[str, ...] = ()


def ordered(items: Sequence[Middleware]) -> list[Middleware]:
    """Outermost first: as ``before`` and ``after`` demand, else the higher priority, then the name."""
    if len({m.name for m in items}) != len(items):
        raise ValueError("middleware names must be unique")
    left, out = sorted(items, key=lambda m: (-m.priority, m.name)), []
    while left:
        free = [m for m in left if not any(o is not m and (o.name in m.after or m.name in o.before) for o in left)]
        if not free:
            raise ValueError("middleware is ordered in a circle")
        out.append(free[0])
        left.remove(free[0])
    return out


def chain(items: Sequence[Middleware], attempt: Attempt, work: Callable[[], Any]) -> Any:
    call = work
    for m in reversed(ordered(items)):
        call = lambda m=m, inner=call: m.call(attempt, inner)
    return call()


def logs(logger: logging.Logger | None = None) -> Middleware:
    log = logger or logging.getLogger("docloom.plans")

    def call(a: Attempt, proceed: Callable[[], Any]) -> Any:
        log.info("%s %s attempt %d by %s", a.run_id, a.step_id, a.number, a.provider)
        try:
            return proceed()
        except Exception:
            log.warning("%s %s attempt %d by %s failed", a.run_id, a.step_id, a.number, a.provider)
            raise

    return Middleware("logging", call, 100)


@dataclass
class Tracer:
    """Keeps a span of every attempt: step, provider, number, seconds, whether it succeeded."""

    spans: list[dict[str, Any]] = field(default_factory=list)

    def middleware(self) -> Middleware:
        def call(a: Attempt, proceed: Callable[[], Any]) -> Any:
            start, ok = time.perf_counter(), False
            try:
                out = proceed()
                ok = True
                return out
            finally:
                self.spans.append({"step_id": a.step_id, "provider": a.provider, "attempt": a.number, "seconds": time.perf_counter() - start, "succeeded": ok})

        return Middleware("tracing", call, 90)


def rate_limits(rate: float, burst: int, key: Callable[[Attempt], str] = lambda a: "default", clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> Middleware:
    """Every key's attempts through its token bucket; an attempt waits for its token."""
    buckets: dict[str, TokenBucket] = {}
    lock = threading.Lock()

    def call(a: Attempt, proceed: Callable[[], Any]) -> Any:
        with lock:
            pause = buckets.setdefault(key(a), TokenBucket(rate, burst)).admit(clock())
        if pause > 0:
            sleep(pause)
        return proceed()

    return Middleware("ratelimit", call, 50)


def retries(times: int, pause: float = 0.0, only: tuple[type[Exception], ...] = (Exception,), sleep: Callable[[float], None] = time.sleep) -> Middleware:
    """Tries the rest of the chain again within one attempt of the step."""

    def call(a: Attempt, proceed: Callable[[], Any]) -> Any:
        for n in range(1, times + 1):
            try:
                return proceed()
            except only:
                if n == times:
                    raise
                sleep(pause)
        return None

    return Middleware("retry", call, 20)


def deadline(seconds: float) -> Middleware:
    """The rest of the chain has to end in time; the thread left behind is not waited for."""

    def call(a: Attempt, proceed: Callable[[], Any]) -> Any:
        pool = ThreadPoolExecutor(1)
        try:
            return pool.submit(proceed).result(seconds)
        finally:
            pool.shutdown(wait=False)

    return Middleware("timeout", call, 10)


class Signals:
    """Named events with handlers; an error of a handler counts only where it is critical."""

    def __init__(self) -> None:
        self._handlers: dict[str, list[tuple[Callable[..., Any], bool]]] = {}

    def connect(self, name: str, handler: Callable[..., Any], critical: bool = False) -> None:
        self._handlers.setdefault(name, []).append((handler, critical))

    def disconnect(self, name: str, handler: Callable[..., Any]) -> None:
        self._handlers[name] = [h for h in self._handlers.get(name, []) if h[0] is not handler]

    def send(self, name: str, **data: Any) -> list[Exception]:
        """Calls the handlers in order; the errors of those that are not critical."""
        errors = []
        for handler, critical in list(self._handlers.get(name, ())):
            try:
                handler(**data)
            except Exception as e:  # noqa: BLE001 - told to the caller
                if critical:
                    raise
                errors.append(e)
        return errors
