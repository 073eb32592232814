"""All registered queries of the flow engine and their SQL oracles."""

from __future__ import annotations

from . import catalog, more
from .surrogate import FACTS


def queries() -> dict:
    return {name: q for name, (q, _) in {**catalog.CATALOG, **more.QUERIES}.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: sql.replace(" FACTS ", f" {FACTS} ").replace(", FACTS FROM", f", {FACTS} FROM") for name, (_, sql) in catalog.CATALOG.items()}
    return found | {name: sql for name, (_, sql) in more.QUERIES.items() if sql}
