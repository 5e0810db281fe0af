"""All registered queries, grouped by what they read."""

from __future__ import annotations

from importlib import import_module

from gleaner.plans.registry import REGISTRY, Query, runner

MODULES = (
    "health",
    "articles",
    "crawl",
    "urls",
    "dates",
    "text",
    "duplicates",
    "html_pages",
    "discovery",
    "apis",
    "ordered",
    "digest",
    "streams",
)


def load() -> dict[str, Query]:
    for name in MODULES:
        import_module(f"gleaner.plans.{name}")
    return REGISTRY


__all__ = ["load", "runner", "Query"]
