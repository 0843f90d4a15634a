"""Registry of named queries: a Spark callable and, where SQL can say it, an oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from answerlake.session import Tables


@dataclass(frozen=True)
class Entry:
    name: str
    ids: str
    build: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, ids: str, sql: str | None = None):
    """Register ``build(tables) -> DataFrame`` under ``name`` for survey rows ``ids``."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, ids, build, sql)
        return build

    return register


def all_entries() -> dict[str, Entry]:
    from answerlake import catalog  # noqa: F401  (importing the modules fills REGISTRY)
    from answerlake.catalog import modules

    modules.load()
    return REGISTRY
