"""Upserts that are compacted: the same rows before and after, touched parts alone, readers undisturbed."""

import os
import random

import pytest
from pyspark.sql import functions as F

from sablefin.operators.kept import KeptTable

SCHEMA = "k long, at long, n long, value string"


@pytest.fixture
def table(spark, tmp_path):
    return KeptTable(spark, str(tmp_path / "kept"), spark.createDataFrame([], SCHEMA).schema, ["k"], "at", ["n"], parts=4), str(tmp_path / "kept")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def files(path):
    return sum(len([f for f in names if f.endswith(".parquet")]) for _, _, names in os.walk(path))


def test_against_a_dictionary(spark, table):
    kept, path = table
    rng, want, number = random.Random(7), {}, 0
    assert rows(kept.latest()) == [] and kept.compact() == 0
    for step in range(12):
        lot = []
        for _ in range(30):
            number += 1
            row = (rng.choice([None, *range(25)]), rng.randrange(40), number, f"v{number}")
            lot.append(row)
            old = want.get(row[0])
            if old is None or (row[1], row[2]) > old[1:3]:
                want[row[0]] = row
        kept.append(spark.createDataFrame(lot, SCHEMA))
        if step % 4 == 3:
            before = rows(kept.latest())
            held = files(path)
            assert 0 < kept.compact() <= 4
            assert rows(kept.latest()) == before == sorted(want.values(), key=str)
            kept.vacuum()
            assert files(path) < held and rows(kept.latest()) == before
            assert kept.compact() == 0
    assert rows(kept.latest()) == sorted(want.values(), key=str)


def test_only_touched_parts_are_written_and_readers_survive(spark, table):
    kept, path = table
    kept.append(spark.range(100).select(F.col("id").alias("k"), F.lit(1).cast("long").alias("at"), F.col("id").alias("n"), F.lit("a").alias("value")))
    assert kept.compact() == 4
    reader = kept.latest()
    one = spark.createDataFrame([(5, 2, 1000, "b")], SCHEMA)
    kept.append(one)
    assert kept.compact() == 1
    bases = sorted(x for x in os.listdir(path) if x.startswith("base="))
    assert len([x for x in os.listdir(f"{path}/{bases[-1]}") if x.startswith("part=")]) == 1
    assert {r.value for r in reader.collect()} == {"a"}  # files of before are still there
    kept.vacuum()
    assert sorted(r.value for r in kept.latest().collect()) == ["a"] * 99 + ["b"]
    assert not [x for x in os.listdir(path) if x.startswith("log=0")]


def test_deletes_and_times_to_live(spark, table):
    kept, path = table
    kept.append(spark.createDataFrame([(i, i, i, "x") for i in range(20)], SCHEMA))
    kept.delete(spark.createDataFrame([(3,), (4,)], "k long"), F.lit(10))
    kept.append(spark.createDataFrame([(4, 11, 100, "again"), (3, 9, 100, "too old")], SCHEMA))
    want = {i: "x" for i in range(20) if i != 3} | {4: "again"}
    assert {r.k: r.value for r in kept.latest().collect()} == want
    kept.compact()
    assert {r.k: r.value for r in kept.latest().collect()} == want
    kept.append(spark.createDataFrame([(i, i, 500, "y") for i in range(20)], SCHEMA))
    kept.compact(F.col("at") >= 15)
    assert {r.k for r in kept.latest().collect()} == set(range(15, 20))
    kept.append(spark.createDataFrame([(i, 0, 0, "z") for i in range(100)], SCHEMA))
    kept.compact(F.lit(False))
    kept.vacuum()
    assert kept.latest().count() == 0 and files(path) == 0


def test_a_compaction_that_was_lost_counts_for_nothing(spark, table):
    kept, path = table
    kept.append(spark.createDataFrame([(1, 1, 1, "a")], SCHEMA))
    kept.compact()
    last = max((x for x in os.listdir(path) if x.startswith("base=")), key=lambda x: int(x[5:]))
    os.remove(f"{path}/{last}/_SUCCESS")
    assert rows(kept.latest()) == [(1, 1, 1, "a")]
    kept.append(spark.createDataFrame([(1, 2, 2, "b")], SCHEMA))
    kept.compact()
    kept.vacuum()
    assert rows(kept.latest()) == [(1, 2, 2, "b")]
