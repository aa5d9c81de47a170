"""Queries by name, with the SQL that gives the same rows where SQL can.

Each is a function of (spark, sf_dir); the number in a name is the operator's in the survey's inventory.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Callable], Callable]:
    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


from gaugeworks.plans import queries_admission, queries_answers, queries_bundles, queries_files, queries_metrics, queries_packing, queries_reports, queries_rounds, queries_routing, queries_scoring, queries_selection, queries_suite, queries_traces, queries_watching  # noqa: E402, F401
