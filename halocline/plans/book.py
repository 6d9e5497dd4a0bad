"""The book of queries: a decorator that files a function under its name, with its SQL and the inventory lines it covers."""

from __future__ import annotations

from collections.abc import Callable

from halocline.plans.standins import with_tables

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}
COVERS: dict[str, str] = {}


def query(covers: str, sql: str | None = None) -> Callable:
    def file(f: Callable) -> Callable:
        QUERIES[f.__name__], COVERS[f.__name__] = f, covers
        if sql:
            ORACLE_SQL[f.__name__] = with_tables(sql)
        return f

    return file
