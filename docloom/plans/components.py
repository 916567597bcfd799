"""Named components, made when first asked for and given what they need, with a forward-only lifecycle."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

STAGES = ("discovered", "validated", "configured", "activated", "deactivated", "unloaded")


class ComponentError(RuntimeError):
    pass


class Lifecycle:
    """An extension's stage; it only goes on, one stage at a time, and hooks run on entering one."""

    def __init__(self, hooks: Mapping[str, Callable[[], Any]] | None = None):
        self.stage, self.hooks = STAGES[0], dict(hooks or {})

    def enter(self, stage: str) -> None:
        if stage not in STAGES or STAGES.index(stage) != STAGES.index(self.stage) + 1:
            raise ComponentError(f"no way from {self.stage} to {stage}")
        self.hooks.get(stage, lambda: None)()
        self.stage = stage


class Components:
    """``provide`` names a factory, what it needs by name, and what its result must be."""

    def __init__(self) -> None:
        self._factories: dict[str, tuple[Callable[..., Any], Mapping[str, str], type | None, Callable[[Any], Any] | None]] = {}
        self._made: dict[str, Any] = {}
        self._making: list[str] = []

    def provide(self, name: str, factory: Callable[..., Any], needs: Mapping[str, str] | None = None, kind: type | None = None, teardown: Callable[[Any], Any] | None = None) -> None:
        """``needs``: argument of the factory to the name of a component."""
        if name in self._factories:
            raise ComponentError(f"component {name!r} is provided already")
        self._factories[name] = (factory, dict(needs or {}), kind, teardown)

    def get(self, name: str) -> Any:
        if name in self._made:
            return self._made[name]
        if name not in self._factories:
            raise ComponentError(f"unknown component {name!r}")
        if name in self._making:
            raise ComponentError(" needs ".join([*self._making, name]))
        factory, needs, kind, _ = self._factories[name]
        self._making.append(name)
        try:
            made = factory(**{arg: self.get(other) for arg, other in needs.items()})
        finally:
            self._making.pop()
        if kind is not None and not isinstance(made, kind):
            raise ComponentError(f"component {name!r} is no {kind.__name__}")
        self._made[name] = made
        return made

    def close(self) -> None:
        """Tears down what was made, the last first."""
        while self._made:
            name, made = self._made.popitem()
            teardown = self._factories[name][3]
            if teardown is not None:
                teardown(made)
