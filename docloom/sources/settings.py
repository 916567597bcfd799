"""Settings and pipeline files: JSON, TOML, YAML (where installed), and the environment."""

from __future__ import annotations

import json
import os
import tomllib
from collections.abc import Mapping
from pathlib import Path
from typing import Any

SECRET = ("password", "secret", "token", "key", "credential")


def load_mapping(path: str) -> dict[str, Any]:
    p = Path(path)
    match p.suffix.lower():
        case ".json":
            data = json.loads(p.read_text())
        case ".toml":
            data = tomllib.loads(p.read_text())
        case ".yaml" | ".yml":
            try:
                import yaml
            except ImportError as e:
                raise ValueError("YAML files need the yaml package") from e
            data = yaml.safe_load(p.read_text())
        case other:
            raise ValueError(f"unknown file type {other!r}")
    if not isinstance(data, dict):
        raise ValueError("the file holds no mapping")
    return data


def merge(base: Mapping[str, Any], *more: Mapping[str, Any]) -> dict[str, Any]:
    """Deep merge; later values win."""
    out = dict(base)
    for m in more:
        for k, v in m.items():
            out[k] = merge(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def from_environment(prefix: str, environment: Mapping[str, str] | None = None) -> dict[str, Any]:
    """``PREFIX_A__B=1`` as {"a": {"b": 1}}; values are JSON where they parse, else text."""
    out: dict[str, Any] = {}
    for name, value in sorted((os.environ if environment is None else environment).items()):
        if not name.startswith(prefix + "_"):
            continue
        path = name[len(prefix) + 1 :].lower().split("__")
        at = out
        for p in path[:-1]:
            at = at.setdefault(p, {})
        try:
            at[path[-1]] = json.loads(value)
        except ValueError:
            at[path[-1]] = value
    return out


def redacted(settings: Mapping[str, Any]) -> dict[str, Any]:
    return {k: redacted(v) if isinstance(v, Mapping) else "***" if any(s in k.lower() for s in SECRET) and v else v for k, v in settings.items()}
