"""Counters, settings, enablement and health."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# States of an index in their order.
STATES = ["Disabled", "Initializing", "Indexing", "Ready", "Updating", "Error"]

# Transitions that a state may take.
TRANSITIONS = {"Disabled": ["Initializing"], "Initializing": ["Indexing", "Ready", "Error"], "Indexing": ["Ready", "Error"], "Ready": ["Updating", "Error"], "Updating": ["Ready", "Error"], "Error": ["Initializing"]}


def tool_stats(calls: DataFrame) -> DataFrame:
    """(tool, total, success, failure) of calls (tool, success)."""
    ok = F.coalesce("success", F.lit(False))
    return calls.groupBy("tool").agg(F.count("*").alias("total"), F.count_if(ok).alias("success"), F.count_if(~ok).alias("failure"))


def enabled(tools: list[str], enable: list[str] | None, disable: list[str]) -> list[str]:
    """What is enabled (all without a list), less what is disabled; in the order of tools."""
    base = set(tools) if enable is None else set(enable)
    return [t for t in tools if t in base and t not in set(disable)]


def enabled_column(enable, more, disable):
    """The same over arrays: what either list enables, each once, less what is disabled."""
    return F.array_except(F.array_union(enable, more), disable)


def first_set(*levels):
    """A field's value from the first level that sets it (project, general, default)."""
    return F.coalesce(*levels)


def merged_settings(project: dict, general: dict, defaults: dict) -> dict:
    """Each field from the project, else from the general settings, else the default; inner objects field by field."""
    out = {}
    for key in {**defaults, **general, **project}:
        got = [d[key] for d in (project, general, defaults) if d.get(key) is not None]
        out[key] = merged_settings(*(d.get(key) or {} for d in (project, general, defaults))) if got and all(isinstance(x, dict) for x in got) else (got[0] if got else None)
    return out


def merged_rows(settings: DataFrame, owner: str = "owner") -> DataFrame:
    """(owner, field, value) of settings (owner, level, field, value): each field from the lowest level that sets it; inner fields are named a.b."""
    best = F.min(F.struct("level", "value"))  # a field that a level sets twice has its least value
    return settings.where(F.col("value").isNotNull()).groupBy(owner, "field").agg(best.alias("s")).select(owner, "field", F.col("s.value").alias("value"))


def load_settings(path: str) -> dict | None:
    """A JSON file of settings; None where there is none, an error where it can't be parsed."""
    import json
    import os

    if not os.path.exists(path):
        return None
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def load_stats(path: str) -> dict:
    """Stored counters; none on any failure to read."""
    try:
        return load_settings(path) or {}
    except (OSError, ValueError):
        return {}


def save_stats(stats: DataFrame, path: str) -> None:
    stats.coalesce(1).write.mode("overwrite").json(path)


def may_become(state: str, new: str) -> bool:
    return new in TRANSITIONS[state]


def state_valid(old, new):
    out = F.lit(False)
    for a, to in TRANSITIONS.items():
        out = out | ((old == a) & new.isin(to))
    return out


def projected(schema: dict) -> dict:
    """A JSON schema's types: what describes (title, description, $schema) is dropped at every level."""
    if not isinstance(schema, dict):
        return schema
    return {k: projected(v) for k, v in schema.items() if k not in ("$schema", "title", "description")}
