"""Names of the corpus queries and their SQL."""

from __future__ import annotations

from acutance.llm import queries as q


def queries() -> dict:
    return {name: getattr(q, name) for name in dir(q) if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict:
    return {name: getattr(q, name.split("_")[0].upper() + "_SQL") for name in queries() if hasattr(q, name.split("_")[0].upper() + "_SQL")}
