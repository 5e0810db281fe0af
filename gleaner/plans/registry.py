"""Query registry: a key, the Spark job, and (where SQL can say it) its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from gleaner.sources.tables import DOMAIN_SQL, Tables


@dataclass(frozen=True)
class Query:
    key: str
    run: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(key: str, sql: str | None = None, using: str = "", macros: str = ""):
    """Register a job. ``using`` names the domain tables the twin selects from."""

    def register(fn: Callable[[Tables], DataFrame]):
        if key in REGISTRY:
            raise ValueError(f"duplicate query key: {key}")
        REGISTRY[key] = Query(key, fn, with_tables(using, sql) if sql else None)
        return fn

    return register


def with_tables(names: str, sql: str) -> str:
    """Prefix ``sql`` with the WITH clause of the named domain tables."""
    needed: list[str] = []

    def need(name: str) -> None:
        if name in needed:
            return
        depends, _ = DOMAIN_SQL[name]
        for d in depends:
            need(d)
        needed.append(name)

    for n in names.split():
        need(n)
    if not needed:
        return sql.strip()
    ctes = ",\n".join(f"{n} AS ({DOMAIN_SQL[n][1].strip()})" for n in needed)
    body = sql.strip()
    if body.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def runner(q: Query) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: q.run(Tables(spark, sf_dir))
