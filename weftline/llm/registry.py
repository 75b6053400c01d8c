"""Queries and SQL of this subpackage, gathered for __spark_entry__.py.

All modules are imported here, so that where a library of theirs is missing the import of this one fails.
"""

from __future__ import annotations

from weftline.llm import cross_split, format_copies, languages, leaks, lookalikes, mixing, packing, sentence_align, splitting

MODULES = [lookalikes, languages, leaks, cross_split, sentence_align, format_copies, packing, mixing, splitting]


def _all(name: str) -> dict:
    found: dict = {}
    for module in MODULES:
        found |= getattr(module, name, {})
    return found


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return {name: sql() if callable(sql) else sql for name, sql in _all("SQL").items()}
