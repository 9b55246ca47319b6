"""The store of runs, logs and checkpoints as append-only tables, and monitoring over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Upper ends of the latency histogram's ranges, in seconds, and the goals of service.
LATENCY_BUCKETS = [0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]
MAX_ERROR_RATE, MAX_P95_MS = 0.01, 500.0
HEARTBEAT_SECONDS, STALE_SECONDS = 30, 300


def latest(df: DataFrame, key: list[str], at: str, tie: list[str]) -> DataFrame:
    """The last row of each key: how updates and upserts are read from appended rows.

    Whole rows are compared as (time, tie-breakers, rest), so this is one aggregation with map-side combine and no window.
    """
    rest = [c for c in df.columns if c not in {*key, at, *tie}]
    last = df.groupBy(*key).agg(F.max(F.struct(at, *tie, *rest)).alias("last"))
    return last.select(*key, "last.*").select(*df.columns)


def append(df: DataFrame, path: str) -> None:
    """Add rows to a table of the store: one run, one log line, or many."""
    df.write.mode("append").parquet(path)


def page(df: DataFrame, order: list[Column | str], offset: int, size: int = 1000) -> DataFrame:
    """Rows ``offset`` to ``offset + size`` along an order."""
    return df.orderBy(*order).offset(offset).limit(size)


def unexpired(df: DataFrame, expires: str, now: Column) -> DataFrame:
    return df.where(F.col(expires) > now)


def latency(logs: DataFrame, key: str, column: str) -> DataFrame:
    """Rows (key, n, avg): nulls are no measurement."""
    return logs.where(F.col(column).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.round(F.avg(column), 6).alias("avg_latency"))


def migrated_runs(runs: DataFrame) -> DataFrame:
    """Runs of one column each as runs with a JSON list of columns."""
    return runs.withColumn("selected_columns", F.to_json(F.array("selected_column"))).drop("selected_column")


def migrated_logs(logs: DataFrame, runs: DataFrame) -> DataFrame:
    """Logs with the column of their run; null where there is no such run."""
    return logs.join(runs.select("run_id", F.col("selected_column").alias("column_name")), "run_id", "left")


def assign(columns: DataFrame, workers: int) -> DataFrame:
    """Rows (position, column_name, worker): contiguous parts of ceil(n / workers) columns, from rows (position, column_name).

    Positions count from 0; a schema's columns are few.
    """
    size = columns.agg(F.ceil(F.count("*") / workers).alias("size"))
    return columns.crossJoin(F.broadcast(size)).select("position", "column_name", F.floor(F.col("position") / F.greatest("size", F.lit(1))).alias("worker"))  # one row


def redistribute(assigned: DataFrame, failed: int) -> DataFrame:
    """``assigned`` with the failed worker's columns dealt in contiguous parts to the others, in order of their numbers."""
    others = assigned.where(F.col("worker") != failed).select("worker").distinct()
    survivors = others.withColumn("part", F.row_number().over(Window.orderBy("worker")) - 1)  # as many rows as workers
    lost = assigned.where(F.col("worker") == failed).withColumn("i", F.row_number().over(Window.orderBy("position")) - 1)  # as many as columns
    sizes = lost.agg(F.count("*").alias("lost")).crossJoin(survivors.agg(F.count("*").alias("left")))  # one row each
    parts = lost.crossJoin(F.broadcast(sizes)).withColumn("part", F.floor(F.col("i") / F.ceil(F.col("lost") / F.col("left"))) % F.col("left"))
    moved = parts.drop("worker").join(survivors, "part").select("position", "column_name", "worker")
    return assigned.where(F.col("worker") != failed).select("position", "column_name", "worker").union(moved)


def progress(processed: DataFrame, total: Column, rate: Column) -> DataFrame:
    """One row (processed, percentage, eta_seconds) from rows (n): null without a rate."""
    once = processed.agg(F.sum("n").alias("processed"), F.max(total).alias("total"), F.max(rate).alias("rate"))
    left = F.greatest(F.col("total") - F.col("processed"), F.lit(0))
    share = F.coalesce(F.try_divide(F.col("processed") * 100.0, F.col("total")), F.lit(0.0))
    return once.select("processed", F.round(share, 6).alias("percentage"), F.when(F.col("rate") > 0, F.floor(left / F.col("rate"))).alias("eta_seconds"))


def gaps(events: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """Rows (key, since, until): where a key was silent for longer than ``seconds``."""
    before = F.lag(at).over(Window.partitionBy(key).orderBy(at))
    out = events.select(key, F.col(at).alias("until"), before.alias("since"))
    return out.where(F.unix_timestamp("until") - F.unix_timestamp("since") > seconds)


def sessions(events: DataFrame, key: str, at: str, seconds: int = STALE_SECONDS) -> DataFrame:
    """Rows (key, first, last, n) of stretches without a gap of ``seconds``; works on streams, too."""
    by = events.groupBy(F.session_window(at, f"{seconds} seconds").alias("w"), key)
    return by.agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n")).drop("w")


def histogram(df: DataFrame, value: Column, buckets: list[float] | None = None) -> DataFrame:
    """Rows (le, n): how many values are at most each bound; one scan, then the one row is turned."""
    bounds = buckets or LATENCY_BUCKETS
    once = df.agg(*(F.count_if(value <= b).alias(f"b{i}") for i, b in enumerate(bounds)))
    turned = F.array(*(F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)))
    return once.select(F.explode(turned).alias("x")).select("x.*")


def service_status(events: DataFrame, at: str, is_error: Column, latency_ms: Column) -> DataFrame:
    """Rows (hour, requests, error_rate, p95, compliant) for each hour."""
    by = events.groupBy(F.window(at, "1 hour")["start"].alias("hour"))
    once = by.agg(F.count("*").alias("requests"), F.round(F.avg(is_error.cast("int")), 6).alias("error_rate"), F.round(F.percentile(latency_ms, 0.95), 6).alias("p95"))
    return once.withColumn("compliant", (F.col("error_rate") <= MAX_ERROR_RATE) & (F.col("p95") <= MAX_P95_MS))


def regressions(measured: DataFrame, baselines: DataFrame, tolerance: float = 0.2) -> DataFrame:
    """Rows (operation, average, baseline, ratio, regressed) of operations that have a baseline."""
    once = measured.groupBy("operation").agg(F.avg("duration").alias("average"))
    out = once.join(baselines, "operation").withColumn("ratio", F.col("average") / F.col("baseline"))
    return out.select("operation", F.round("average", 6).alias("average"), "baseline", F.round("ratio", 6).alias("ratio"), (F.col("ratio") > 1 + tolerance).alias("regressed"))


def health(components: DataFrame, by: str, name: str, healthy: Column) -> DataFrame:
    """Rows (by, components, unhealthy, status): ``healthy`` if all of its components are, else ``degraded``, with their names."""
    once = components.groupBy(by).agg(F.count("*").alias("components"), F.array_join(F.sort_array(F.collect_set(F.when(~healthy, F.col(name)))), ",").alias("unhealthy"))
    return once.withColumn("status", F.when(F.col("unhealthy") == "", "healthy").otherwise("degraded"))


def cache_use(access: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """Rows (key, hits, misses, expired) of a cache's use: an access is a hit if the key was put or read at most ``seconds``
    before, each of which renews its time; other accesses put it, and count as expired if it was there before."""
    before = F.lag(at).over(Window.partitionBy(key).orderBy(at))
    fresh = F.col(at) <= before + F.expr(f"INTERVAL {seconds} SECONDS")
    marked = access.select(key, fresh.alias("fresh"))
    return marked.groupBy(key).agg(F.count_if("fresh").alias("hits"), F.count_if(~F.coalesce("fresh", F.lit(False))).alias("misses"), F.count_if(~F.col("fresh")).alias("expired"))


def invalidated(entries: DataFrame, prefix: str | None = None, key: str = "cache_key") -> DataFrame:
    """What a cache keeps once the keys with a prefix are dropped; nothing without a prefix."""
    return entries.where(F.lit(False)) if prefix is None else entries.where(~F.col(key).startswith(prefix))
