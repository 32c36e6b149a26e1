"""Every query of the core with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from paperloom.plans import channel, checks, drafts, extras, more, p3, readouts, runs, search, stats, text

MODULES = [p3, text, search, stats, readouts, checks, runs, extras, more, channel, drafts]


def queries() -> dict[str, Callable]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
