"""All registered queries and their SQL."""

from __future__ import annotations

import importlib

from marginalia.plans.tables import Tables
from marginalia.session import ship

AREAS = ["q_text", "q_questions", "q_access", "q_evaluation", "q_structure", "q_retrieval", "q_graph", "q_sheets", "q_evidence",
         "q_streaming", "q_routing", "q_updates"]


def _entries() -> dict:
    out = {}
    for area in AREAS:
        module = importlib.import_module(f"marginalia.plans.{area}")
        for name, item in module.QUERIES.items():
            assert name not in out, name
            out[name] = item
    return out


def _runner(fn):
    def run(spark, sf_dir):
        ship(spark)
        return fn(Tables(spark, sf_dir))

    return run


def queries() -> dict:
    return {name: _runner(fn) for name, (fn, _) in _entries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _entries().items() if sql}
