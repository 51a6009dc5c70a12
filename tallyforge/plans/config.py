"""Layered report settings from a JSON file."""

from __future__ import annotations

import json
from pathlib import Path


def load_config(paths: list[str]) -> dict:
    """The first of the files that holds a JSON object."""
    for path in paths:
        try:
            value = json.loads(Path(path).read_text())
        except (OSError, ValueError):
            continue
        if isinstance(value, dict):
            return value
    return {}


def settings(config: dict, report: str, agent: str | None = None, **given) -> dict:
    """Defaults, then the command, then the tool's own; later layers win field by field, and
    what is ``given`` (not None) wins over all."""
    pick = lambda *keys: _at(config, keys)
    layers = [pick("defaults"), pick("commands", report if agent is None else f"{agent} {report}")]
    if agent is not None:
        layers += [pick("commands", report), pick("commands", f"{agent}:{report}"), pick(agent, "defaults"), pick(agent, "commands", report)]
    out: dict = {}
    for layer in layers:
        out |= layer
    return out | {k: v for k, v in given.items() if v is not None}


def _at(value, keys) -> dict:
    for key in keys:
        value = value.get(key) if isinstance(value, dict) else None
    return value if isinstance(value, dict) else {}
