"""All queries of the core: name -> function of (spark, directory), and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from . import evidence, files, forecasting, quality, relational, repairs, retrieving, survey, textual

MODULES = (quality,)
BOOKS = (survey.BOOK, textual.BOOK, relational.BOOK, evidence.BOOK, forecasting.BOOK, retrieving.BOOK, files.BOOK, repairs.BOOK)


def queries() -> dict[str, Callable]:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()} | {name: q for b in BOOKS for name, q in b.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()} | {name: sql for b in BOOKS for name, sql in b.sql.items()}
