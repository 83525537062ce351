"""All registered queries and their SQL."""

from __future__ import annotations

from tessera.plans import certification, information, lattices, preparation, protocols

PARTS = (information, certification, lattices, protocols, preparation)
QUERIES: dict = {name: run for part in PARTS for name, run in part.QUERIES.items()}
SQL: dict[str, str] = {name: text for part in PARTS for name, text in part.SQL.items()}
