"""Streams with state: dictionaries over restarts, who is alive, rows set aside."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from sablefin.errors import StreamRowError
from sablefin.functions.patterns import default_pii
from sablefin.operators import tokenise
from sablefin.streaming import state

SCHEMA = "id long, n long, text string"


def put(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def tables(spark, path):
    found = [f"{path}/{x}" for x in os.listdir(path) if x.startswith("batch=")]
    return spark.read.parquet(*found)


def again(checkpoint):
    """Forget that the last batch was committed, as if the driver had been lost just before."""
    commits = f"{checkpoint}/commits"
    last = max(int(x) for x in os.listdir(commits) if x.isdigit())
    for name in (str(last), f".{last}.crc"):
        if os.path.exists(f"{commits}/{name}"):
            os.remove(f"{commits}/{name}")


def test_one_token_for_each_original_over_batches_and_restarts(spark, tmp_path):
    source, target, kept, checkpoint = (str(tmp_path / n) for n in ("source", "target", "kept", "checkpoint"))
    parts = [
        [(1, 0, "a@b.com and 123-45-6789"), (1, 1, "a@b.com"), (None, 2, "c@d.org [EMAIL-0]"), (2, 3, None)],
        [(1, 4, "x a@b.com, new e@f.net"), (None, 5, None), (3, 6, "")],
        [(9, 7, "e@f.net c@d.org g@h.com 123-45-6789 " * 3)],
        [(10, 8, "i@j.com a@b.com"), (10, 8, "i@j.com a@b.com")],
    ]

    def run(files):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(source)
        query = state.tokenise_stream(stream, "id", "text", default_pii(), target, kept, checkpoint, buckets=3)
        query.awaitTermination()

    for part in parts[:2]:
        put(spark, source, part)
    run(1)
    first = {r.original: r.token for r in tables(spark, kept).collect()}
    for part in parts[2:]:
        put(spark, source, part)
    run(2)
    tokens = tables(spark, kept)
    rows = tokens.collect()
    assert len({r.original for r in rows}) == len({r.token for r in rows}) == len({r.number for r in rows}) == len(rows) == 7
    assert first.items() <= {r.original: r.token for r in rows}.items()
    done = tables(spark, target)
    assert not any(r.original in (d.text or "") for r in rows if r.pattern_type != tokenise.LITERAL for d in done.collect())
    back = tokenise.detokenise(done.drop("tokens_used"), "n", "text", tokens).select("id", "n", "text").collect()
    assert sorted(map(tuple, back), key=str) == sorted((r for p in parts for r in p), key=str)
    seen = sorted(map(tuple, done.select("id", "n", "text").collect()), key=str)
    again(checkpoint)
    run(2)  # the last batch runs again: nothing is counted twice
    assert sorted(map(tuple, tables(spark, target).select("id", "n", "text").collect()), key=str) == seen
    assert sorted(map(tuple, tables(spark, kept).collect())) == sorted(map(tuple, rows))


def test_silence_is_told_without_a_further_event(spark, tmp_path):
    source, checkpoint = str(tmp_path / "source"), str(tmp_path / "checkpoint")
    put(spark, source, [(1, 1000, "x"), (1, 5000, "x"), (2, 3000, "x"), (None, 1, "x")])
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    told = state.liveness(stream, F.col("id"), F.timestamp_millis("n"), timeout_ms=30_000, late_ms=1000)
    query = told.writeStream.format("memory").queryName("told").outputMode("append").option("checkpointLocation", checkpoint).trigger(processingTime="200 milliseconds").start()
    try:
        end = time.time() + 180
        while time.time() < end and spark.table("told").where("status = 'live'").count() < 2:
            time.sleep(0.2)
        put(spark, source, [(1, 3500, "late"), (1, 4500, "not late"), (1, 9000, "x")])
        while time.time() < end and spark.table("told").where("status = 'silent'").count() < 2:
            time.sleep(0.2)
        assert query.exception() is None
        rows = {(r.key, r.status): (r.last.timestamp() * 1000, r.late) for r in spark.table("told").select("key", "status", "last", "late").collect()}
        events = {(r.key, r.status): r.events for r in spark.table("told").collect()}
        assert set(rows) == {("1", "live"), ("2", "live"), ("1", "silent"), ("2", "silent")}
        assert rows["1", "silent"] == (9000, 1) and events["1", "silent"] == 5 and rows["2", "silent"] == (3000, 0)
    finally:
        query.stop()


def test_rows_that_fail_are_set_aside_once(spark, tmp_path):
    source, good, bad, checkpoint = (str(tmp_path / n) for n in ("source", "good", "bad", "checkpoint"))
    rows = [(1, 1, '{"a":"x@y.com"}'), (2, 2, "no json"), (3, 3, None), (None, 4, '{"a":1}'), (5, 5, '["z@y.com"]')]
    put(spark, source, rows[:3])
    put(spark, source, rows[3:])
    checks = {"no key": F.col("id").isNotNull(), "no JSON": F.try_parse_json("text").isNotNull()}
    change = lambda df: df.withColumn("text", tokenise.tokenise_json(F.col("text")))

    def run(checkpoint, **more):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        state.with_quarantine(stream, checks, change, good, bad, checkpoint, **more).awaitTermination()

    run(checkpoint)

    def read():
        return sorted((r.id, json.loads(r.text)) for r in tables(spark, good).collect()), sorted((r.n, r.error) for r in tables(spark, bad).collect())

    before = read()
    assert before[1] == [(2, "no JSON"), (3, "no JSON"), (4, "no key")]
    assert [i for i, _ in before[0]] == [1, 5] and "@" not in str(before[0])
    again(checkpoint)
    run(checkpoint)
    assert read() == before
    with pytest.raises(Exception, match="StreamRowError"):
        run(str(tmp_path / "other"), continue_on_error=False)
    assert issubclass(StreamRowError, Exception)
