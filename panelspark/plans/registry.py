"""All queries of the panel library with their SQL."""

from __future__ import annotations

from panelspark.plans import company, controls, features, live, portfolio, research, states

MODULES = (features, states, research, portfolio, company, controls, live)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
