"""Query catalog: name -> Spark callable ``(spark, sf_dir) -> DataFrame`` and,
where the job is expressible in SQL, an independent DuckDB oracle query over
the same benchmark tables."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco
