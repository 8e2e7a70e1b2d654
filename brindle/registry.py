"""Queries of the library with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | Callable[[], str] | None = None  # or a function that writes it


class Registry:
    """Named queries; a name is given once."""

    def __init__(self) -> None:
        self._entries: dict[str, Entry] = {}

    def add(self, name: str, run: Query, sql: str | Callable[[], str] | None = None) -> None:
        if name in self._entries:
            raise ValueError(f"query {name} is registered already")
        self._entries[name] = Entry(run, sql)

    def queries(self) -> dict[str, Query]:
        return {k: e.run for k, e in self._entries.items()}

    def oracle_sql(self) -> dict[str, str]:
        return {k: e.sql() if callable(e.sql) else e.sql for k, e in self._entries.items() if e.sql}
