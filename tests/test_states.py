"""Sketches against exact values, and counters of running jobs against their results."""

import time

import pytest
from pyspark.sql import functions as F

from sablefin.operators import runs, sketches
from sablefin.streaming import metrics


def test_states_of_parts_are_the_state_of_the_whole(spark):
    n = 60_000
    df = spark.range(n).select(
        (F.col("id") * 7919 % 20_011).alias("key"),
        F.when(F.col("id") % 5 > 0, F.concat(F.lit("w"), F.col("id") % 37)).alias("word"),
        F.when(F.col("id") % 3 == 0, F.lit("x")).otherwise((F.col("id") % 1000).cast("string")).alias("mixed"),
        F.lit(None).cast("string").alias("nothing"),
        (F.col("id") % 4).alias("part"),
    )
    columns = ["key", "word", "mixed", "nothing"]
    parts = sketches.column_states(df, columns, F.col("part"))
    assert parts.count() == 16
    halves = sketches.merged_states(parts.withColumn("half", F.col("part").cast("int") % 2), ["half", "column_name"])
    whole = {r.column_name: r for r in sketches.told(sketches.column_states(df, columns)).collect()}
    for states in (sketches.merged_states(parts), sketches.merged_states(halves)):
        for r in sketches.told(states).collect():
            w = whole[r.column_name]
            assert (r["rows"], r.nulls, r.avg_bytes, r.numeric) == (w["rows"], w.nulls, w.avg_bytes, w.numeric)
            assert r.distinct == pytest.approx(w.distinct, rel=0.04)  # a merged sketch has another estimator
            exact = df.agg(F.count_distinct(r.column_name)).first()[0]
            assert abs(r.distinct - exact) <= 4 * 0.0163 * exact
    told = {r.column_name: r for r in sketches.told(sketches.merged_states(parts)).collect()}
    assert (told["nothing"].nulls, told["nothing"].distinct, told["nothing"].length_50, told["nothing"].avg_bytes) == (n, 0, None, None)
    for q, found in ((0.5, told["key"].number_50), (0.95, told["key"].number_95)):
        assert abs(df.where(F.col("key") <= found).count() / n - q) < 0.03
    assert told["mixed"].numeric == pytest.approx(2 / 3, abs=1e-6) and told["word"].numeric == 0 and told["word"].number_50 is None
    assert sketches.told(sketches.merged_states(sketches.column_states(df.limit(0), columns))).count() == 0


def test_percentiles_of_groups_merge(spark):
    df = spark.range(24_000).select((F.col("id") % 6).alias("hour"), (F.col("id") * 31 % 24_000).alias("ms"))
    hours = sketches.latency_states(df, F.col("hour"), F.col("ms"))
    day = hours.agg(F.sum("requests").alias("n"), F.kll_sketch_get_quantile_double(F.kll_merge_agg_double("latencies"), F.lit(0.95)).alias("p95")).first()
    assert day.n == 24_000 and abs(day.p95 / 24_000 - 0.95) < 0.02


def test_observed_counts_equal_the_result(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 10 > 0, F.col("id") / 100).alias("seconds"))
    passed, seen = metrics.counted_once(df, F.col("seconds"))
    assert passed.where("seconds > 1").count() > 0
    plain = {r.le: r.n for r in runs.histogram(df, F.col("seconds")).collect()}
    got = seen.get
    assert got["rows"] == 1000 and got["nulls"] == 100 and got["total"] == pytest.approx(df.agg(F.sum("seconds")).first()[0])
    assert [got[f"le_{i}"] for i in range(len(plain))] == [plain[b] for b in sorted(plain)]


def test_histogram_fills_while_a_stream_runs(spark, tmp_path):
    source = str(tmp_path / "source")
    df = spark.range(400).select("id", F.when(F.col("id") % 7 > 0, F.col("id") / 40).alias("seconds")).repartition(4)
    df.write.parquet(source)
    histogram = metrics.RunningHistogram("latency")
    spark.streams.addListener(histogram)
    try:
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
        query = metrics.counted(stream, "latency", F.col("seconds")).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
        end = time.time() + 20
        while histogram.now()["rows"] < 400 and time.time() < end:
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(histogram)
    now = histogram.now()
    assert (now["batches"], now["rows"], now["nulls"]) == (4, 400, 58)
    assert now["histogram"] == [(r.le, r.n) for r in runs.histogram(df, F.col("seconds")).orderBy("le").collect()]
    assert now["mean"] == pytest.approx(df.agg(F.avg("seconds")).first()[0])
