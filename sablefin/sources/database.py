"""Reads of a database query that split themselves: a Spark data source over any DB-API module.

The database is asked for evenly spaced keys of the query's rows; each task then reads the rows between two of them with a cursor
of its own. No bounds are asked of the caller, skewed keys give parts of like size, and rows with a null key are a part, too.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sablefin.errors import ConfigError

from .workers import reach_package

NAME = "sablefin_database"


@dataclass
class KeyRange(InputPartition):
    """Rows with ``above`` < key <= ``upto``; None is no bound. ``nulls``: the rows without a key instead."""

    above: object = None
    upto: object = None
    nulls: bool = False


class QueryReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        missing = {"driver", "connect", "query", "key"} - set(options)
        if missing:
            raise ConfigError(f"options that are missing: {', '.join(sorted(missing))}")
        self._options = dict(options)
        self._parts, self._fetch = int(options.get("partitions", "8")), int(options.get("fetchsize", "1000"))
        if self._parts < 1 or self._fetch < 1:
            raise ConfigError("partitions and fetchsize must be 1 or more")

    def _connection(self):  # noqa: ANN202
        return importlib.import_module(self._options["driver"]).connect(**json.loads(self._options["connect"]))

    def _mark(self) -> str:
        return "?" if importlib.import_module(self._options["driver"]).paramstyle == "qmark" else "%s"

    def partitions(self) -> list[InputPartition]:
        """One range for each quantile of the keys; equal keys stay together, so there may be fewer."""
        key, query = self._options["key"], self._options["query"]
        sql = f"""SELECT DISTINCT edge FROM (SELECT {key} AS edge, ROW_NUMBER() OVER (ORDER BY {key}) AS place, COUNT(*) OVER () AS whole
                  FROM ({query}) rows_of_query WHERE {key} IS NOT NULL) keyed WHERE place * {self._parts} / whole > (place - 1) * {self._parts} / whole AND place < whole ORDER BY edge"""
        with closing(self._connection()) as connection, closing(connection.cursor()) as cursor:
            cursor.execute(sql)
            edges = [row[0] for row in cursor.fetchall()]
        ranges = [KeyRange(a, b) for a, b in zip([None, *edges], [*edges, None])]
        return [*ranges, KeyRange(nulls=True)]

    def read(self, partition: KeyRange) -> Iterator[tuple]:
        key, mark = self._options["key"], self._mark()
        holds = [f"{key} IS NULL"] if partition.nulls else [f"{key} IS NOT NULL"]
        values = []
        for bound, sign in ((partition.above, ">"), (partition.upto, "<=")):
            if bound is not None:
                holds.append(f"{key} {sign} {mark}")
                values.append(bound)
        with closing(self._connection()) as connection, closing(connection.cursor()) as cursor:
            cursor.execute(f"SELECT * FROM ({self._options['query']}) rows_of_query WHERE {' AND '.join(holds)}", values)
            while rows := cursor.fetchmany(self._fetch):
                yield from map(tuple, rows)


class QuerySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        raise ConfigError("the rows' schema must be given")

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return QueryReader(self.options)


def database(spark: SparkSession, driver: str, connect: dict, query: str, key: str, schema: str, partitions: int = 8, fetch_size: int = 1000) -> DataFrame:
    """The rows of a query, read by about ``partitions`` tasks that deal its rows out evenly by ``key``, which may be of any type
    that the database can order, repeat and be null.

    ``driver`` is the name of a DB-API module that executors have, ``connect`` the arguments of its ``connect``. Every task sees the query
    as it is when it reads; where rows change meanwhile, give a query that doesn't.
    """
    reach_package(spark)
    spark.dataSource.register(QuerySource)
    options = {"driver": driver, "connect": json.dumps(connect), "query": query, "key": key, "partitions": str(partitions), "fetchsize": str(fetch_size)}
    return spark.read.format(NAME).options(**options).schema(schema).load()
