"""All queries over the driver's tables, with the SQL that says the same."""

from __future__ import annotations

from . import generation, parsing, scoring, taxonomy

MODULES = (taxonomy, generation, parsing, scoring)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
