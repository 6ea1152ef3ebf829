"""Configuration: precedence of layers, service levels, provider choice, key format."""

from __future__ import annotations

import re
from collections.abc import Mapping

# Defaults, and the limits of the model stage by service level.
DEFAULTS = {"scan": {"include": ["**/*.ts", "**/*.py", "**/*.java", "**/*.go", "**/*.kt"], "exclude": ["**/*.test.*"]}, "sla": "L1", "locale": "en", "scoring": {"threshold": 70}}
SLA = {"L1": {"max_blocks": 0, "similarity": 0.0}, "L2": {"max_blocks": 20, "similarity": 0.7}, "L3": {"max_blocks": 30, "similarity": 0.65}}
NESTED = ("scan", "scoring")


def merge(*layers: Mapping) -> dict:
    """Later layers win, key by key in ``scan`` and ``scoring``; None never wins; unknown levels are ignored."""
    out: dict = {}
    for layer in layers:
        for k, v in (layer or {}).items():
            if v is None or (k == "sla" and v not in SLA):
                continue
            out[k] = {**out.get(k, {}), **{a: b for a, b in v.items() if b is not None}} if k in NESTED else v
    return out


def load(user: Mapping = (), project: Mapping = (), environment: Mapping = (), overrides: Mapping = ()) -> dict:
    return merge(DEFAULTS, dict(user), dict(project), dict(environment), dict(overrides))


def recommended_sla(ai: Mapping) -> str:
    """L3 with a remote key, L2 with a local model, else L1."""
    return "L3" if (ai.get("remote") or {}).get("api_key") else "L2" if ai.get("local") else "L1"


def sla_errors(level: str, ai: Mapping) -> list[str]:
    need = {"L2": [("local", "model")], "L3": [("remote", "api_key"), ("remote", "model")]}.get(level, [])
    return [f"{level} requires {a}.{b}" for a, b in need if not (ai.get(a) or {}).get(b)]


def should_degrade(elapsed_ms: float, target_ms: float) -> bool:
    """At 80 % of the target, costly stages are dropped."""
    return elapsed_ms >= 0.8 * target_ms


def stages(level: str) -> list[str]:
    return ["structural", "embedding", "model"][: {"L1": 1, "L2": 2, "L3": 3}[level]]


def key_format(key: str, prefix: str) -> bool:
    """PREFIX and four groups of four letters or digits that can't be mistaken for each other."""
    return re.fullmatch(re.escape(prefix) + r"(?:-[A-HJ-NP-Z2-9]{4}){4}", key) is not None
