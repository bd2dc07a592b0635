"""Operators for language-model data and large-set algorithms; nothing else imports this."""

from __future__ import annotations

from types import ModuleType

from blockloom.llm import contamination_queries, distinct_queries, frequent_queries, mixture_queries, severity_queries


def modules() -> list[ModuleType]:
    """Modules with QUERIES and ORACLE."""
    return [distinct_queries, frequent_queries, contamination_queries, mixture_queries, severity_queries]
