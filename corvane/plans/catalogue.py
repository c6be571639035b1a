"""All queries of the library, with the SQL that states the same result."""

from __future__ import annotations

import importlib

#: Modules of this folder with a table QUERIES: name -> (query, SQL or None).
MODULES = ("retrieval", "dialog", "scorecard", "codes", "guards", "integrity", "evaluation", "streams", "lists", "outside")


def _all() -> dict:
    out: dict = {}
    for name in MODULES:
        found = importlib.import_module(f"corvane.plans.{name}").QUERIES
        assert not out.keys() & found.keys(), name
        out |= found
    return out


def queries() -> dict:
    return {name: query for name, (query, _) in _all().items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in _all().items() if sql}
