"""Readers, settings and stream events."""

import json
import time

import pytest
from pyspark.sql import functions as F

from sablefin.errors import SourceError
from sablefin.sources import scratch, tables
from sablefin.sources.config import load_config
from sablefin.streaming import detection as streaming
from sablefin.streaming.events import EventSink


def test_layers_of_settings(tmp_path):
    assert load_config(environment={}).calls_per_second == 3.0
    env = {"SABLEFIN_ENDPOINT": "http://a", "SABLEFIN_BATCH_SIZE": "5", "SABLEFIN_API_KEY": "secret"}
    config = load_config(environment=env, endpoint="http://b", batch_size=None)
    assert (config.endpoint, config.batch_size) == ("http://b", 5) and "secret" not in repr(config)
    rules = tmp_path / "rules.json"
    rules.write_text(json.dumps([{"pattern": "x+", "label": "X"}]))
    assert [(r.pattern_type, r.regex) for r in load_config(str(rules), {}).rules] == [("X", "x+")]
    for bad in ({"environment": {"SABLEFIN_BATCH_SIZE": "many"}}, {"rule_file": str(tmp_path / "none"), "environment": {}}, {"nope": 1, "environment": {}}):
        with pytest.raises(SourceError):
            load_config(**bad)


def test_csv_keeps_malformed_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id;note\n1;"a;b"\n2;x;extra\n3\n')
    found = tables.csv(spark, str(tmp_path), ";").orderBy("id").collect()
    assert [tuple(r) for r in found] == [("1", "a;b"), ("2", "x"), ("3", None)]


@pytest.mark.parametrize("kind", ["json", "csv", "parquet"])
def test_written_formats(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, "é,\"x\""), (2, None)], "id long, t string")
    tables.write(df, str(tmp_path / "out"), kind)
    assert spark.read.format(kind).option("header", True).load(str(tmp_path / "out")).count() == 2


def test_first_n_is_the_same_each_time(spark):
    df = spark.range(1000).repartition(7)
    assert [r.id for r in tables.first_n(df, "id", 5).collect()] == [0, 1, 2, 3, 4]


def test_scratch_tables(spark):
    df = spark.range(5).withColumn("x", F.col("id") * 2)
    kept = scratch.written(df, "t")
    assert sorted(kept.collect()) == df.collect()
    assert [(f.name, f.dataType) for f in kept.schema] == [(f.name, f.dataType) for f in df.schema]
    scratch.drop_written(kept)
    with pytest.raises(Exception):
        kept.collect()


def test_scopes_of_scratch_tables(spark):
    with scratch.temporary():
        with scratch.temporary() as keep:
            one, two = scratch.written(spark.range(3), "t"), scratch.written(spark.range(4), "t")
            two = keep(two)
        assert two.count() == 4
        with pytest.raises(Exception):
            one.count()
    with pytest.raises(Exception):
        two.count()


def test_stream_equals_batch_however_files_are_cut(spark, tmp_path):
    lines = [f"line {i} of customer{i}@example.com, {i % 900 + 100:03d}-12-3456" for i in range(300)]
    results = []
    for name, parts in (("a", 1), ("b", 9)):
        spark.createDataFrame([(x,) for x in lines], "value string").repartition(parts).write.text(str(tmp_path / name))
        streaming.tokenise_lines(spark, str(tmp_path / name), str(tmp_path / f"{name}-out")).awaitTermination()
        results.append(sorted(r.value for r in spark.read.text(str(tmp_path / f"{name}-out")).collect()))
    assert results[0] == results[1] and len(results[0]) == 300 and not any("@" in x for x in results[0])


def test_events_of_a_stream(spark, tmp_path):
    seen: list[dict] = []
    sink = EventSink(lambda line: seen.append(json.loads(line)))
    spark.streams.addListener(sink)
    try:
        spark.createDataFrame([("a",)], "value string").write.text(str(tmp_path / "in"))
        streaming.tokenise_lines(spark, str(tmp_path / "in"), str(tmp_path / "out")).awaitTermination()
        for _ in range(100):
            if {"started", "progress", "complete"} <= {x["type"] for x in seen}:
                break
            time.sleep(0.1)
        assert {"started", "progress", "complete"} <= {x["type"] for x in seen}
    finally:
        spark.streams.removeListener(sink)
