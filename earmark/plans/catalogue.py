"""All queries of the engine's own operators, with DuckDB SQL for the same rows."""

from __future__ import annotations

from . import analysis, evaluation, registry, rights, similarity

MODULES = (similarity, rights, registry, evaluation, analysis)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
