"""Queries and SQL of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from paperloom.llm import p1, p2, p4, p5, p6, p7, p8, p9

MODULES = [p1, p2, p4, p5, p6, p7, p8, p9]


def queries() -> dict[str, Callable]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
