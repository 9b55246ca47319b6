"""How queries are registered: each module has a ``QUERIES`` dict of functions and an ``ORACLES`` dict of DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: DuckDB twin of the made-up contacts.
CONTACTS = """contacts AS (
  SELECT c_custkey AS id, 'customer' || c_custkey || '@example.com' AS email,
         printf('%03d-%02d-%04d', c_custkey % 900 + 100, c_custkey % 99 + 1, c_custkey % 9000 + 1000) AS ssn,
         printf('555-%03d-%04d', c_custkey % 900 + 100, c_custkey % 10000) AS phone,
         'Call 555-123-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || ' or write to customer' || (c_custkey % 50)
           || '@example.com' AS note
  FROM customer)"""


def quoted(text: str) -> str:
    """A text as a SQL literal."""
    return "'" + text.replace("'", "''") + "'"


def count_sql(column: str, regexes: list[str]) -> str:
    """DuckDB: how often the regexes match, added up."""
    return "(" + " + ".join(f"len(regexp_extract_all({column}, {quoted(r)}))" for r in regexes) + ")"


class Registry:
    """Collects queries by name, with the SQL that gives the same rows."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(query: Query) -> Query:
            self.queries[name] = query
            if sql is not None:
                self.oracles[name] = sql
            return query

        return keep
