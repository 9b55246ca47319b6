"""Database reads that split themselves."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from sablefin.errors import ConfigError
from sablefin.sources.database import QueryReader, database


@pytest.fixture(scope="module")
def place(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("db") / "rows.db")
    rows = [(i * i * i, f"name {i % 7}", i / 2) for i in range(2000)] + [(None, "no key", None)] * 5 + [(77, "again", 1.0)] * 3
    with sqlite3.connect(path) as connection:
        connection.execute("CREATE TABLE t (k INTEGER, name TEXT, x REAL)")
        connection.executemany("INSERT INTO t VALUES (?, ?, ?)", rows)
    return path, rows


def read(spark, path, query="SELECT * FROM t", key="k", **more):
    return database(spark, "sqlite3", {"database": path}, query, key, "k long, name string, x double", **more)


def test_skewed_keys_give_even_parts(spark, place):
    path, rows = place
    df = read(spark, path, partitions=6, fetch_size=17)
    assert sorted(map(tuple, df.collect()), key=str) == sorted(rows, key=str)
    sizes = {r.p: r["count"] for r in df.where("k IS NOT NULL").groupBy(F.spark_partition_id().alias("p")).count().collect()}
    assert len(sizes) == 6 and max(sizes.values()) <= min(sizes.values()) + 5
    assert df.where("k IS NULL").count() == 5


def test_keys_of_texts_and_few_rows(spark, place):
    path, rows = place
    assert read(spark, path, key="name", partitions=20).count() == len(rows)
    assert read(spark, path, "SELECT * FROM t WHERE k = 77", partitions=4).count() == 3
    assert read(spark, path, "SELECT * FROM t WHERE k < 0").count() == 0
    assert read(spark, path, "SELECT * FROM t WHERE k IS NULL").count() == 5
    assert read(spark, path, partitions=1).count() == len(rows)


def test_wrong_options(place):
    with pytest.raises(ConfigError):
        QueryReader({"driver": "sqlite3"})
    with pytest.raises(ConfigError):
        QueryReader({"driver": "sqlite3", "connect": "{}", "query": "", "key": "k", "partitions": "0"})
