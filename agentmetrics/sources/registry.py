"""Source plugins by tool name.

A plugin turns what a tool left behind into the common tables. New tools are
added with ``register``; the names are those records carry as source_tool.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

SOURCES: dict[str, Callable[..., "Extract"]] = {}


@dataclass
class Extract:
    """Tables of one source; a table the tool cannot provide is absent."""

    sessions: DataFrame
    units: DataFrame | None = None
    unit_tools: DataFrame | None = None
    unit_files: DataFrame | None = None
    models: DataFrame | None = None
    tools: DataFrame | None = None
    prompt_sources: DataFrame | None = None
    content: DataFrame | None = None
    rejects: DataFrame | None = None
    extra: dict[str, DataFrame] = field(default_factory=dict)


def normalise(name: str) -> str:
    return name.strip().lower().replace("-", "_")


def register(name: str):
    def add(plugin: Callable[..., Extract]):
        SOURCES[normalise(name)] = plugin
        return plugin
    return add


def extract_from(spark: SparkSession, name: str, **where) -> Extract:
    return SOURCES[normalise(name)](spark, **where)
