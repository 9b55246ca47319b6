"""Queries of the run store, of workers and of monitoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sablefin.operators import runs
from sablefin.operators.kept import KeptTable
from sablefin.sources import scratch, tables

from .common import Registry

registry = Registry()

# Runs are orders, their logs are lines; checkpoints are events by user and hour.
_RUNS = """runs AS (SELECT o_orderkey AS run_id, o_custkey AS file_id, (['sentiment', 'entity', 'classification'])[o_orderkey % 3 + 1] AS selected_column, o_orderdate AS started_at, o_orderstatus AS status FROM orders)"""
_LOGS = """logs AS (SELECT l_orderkey AS run_id, l_orderkey * 10 + l_linenumber AS log_id, 'column_' || (l_linenumber % 3) AS column_name, CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_quantity AS BIGINT) * 10 END AS latency_ms, l_shipdate AS created_at FROM lineitem)"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.element_at(F.array(*map(F.lit, ["sentiment", "entity", "classification"])), (F.col("o_orderkey") % 3 + 1).cast("int"))
    rows = tables.parquet(spark, sf_dir, "orders")
    return rows.select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("file_id"), kinds.alias("selected_column"), F.col("o_orderdate").alias("started_at"), F.col("o_orderstatus").alias("status"))


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("l_linenumber")
    took = F.when(line != 7, F.col("l_quantity").cast("long") * 10)
    rows = tables.parquet(spark, sf_dir, "lineitem")
    return rows.select(
        F.col("l_orderkey").alias("run_id"), (F.col("l_orderkey") * 10 + line).alias("log_id"), F.concat(F.lit("column_"), (line % 3).cast("string")).alias("column_name"), took.alias("latency_ms"), F.col("l_shipdate").alias("created_at")
    )


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.parquet(spark, sf_dir, "events")


@registry.add("run_lookup", f"WITH {_RUNS} SELECT * FROM runs WHERE run_id = 33")
def run_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).where("run_id = 33")


@registry.add("logs_by_column", f"WITH {_LOGS} SELECT * FROM logs WHERE run_id = (SELECT max(run_id) FROM logs WHERE column_name = 'column_0') AND column_name = 'column_0' ORDER BY created_at, log_id")
def logs_by_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The logs of a column in the newest run that has any."""
    logs = _logs(spark, sf_dir).where("column_name = 'column_0'")
    newest = logs.agg(F.max("run_id").alias("run_id"))
    return logs.join(F.broadcast(newest), "run_id").orderBy("created_at", "log_id")  # one row


@registry.add("logs_page", f"WITH {_LOGS} SELECT * FROM logs ORDER BY created_at, run_id, log_id LIMIT 1000 OFFSET 1000")
def logs_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.page(_logs(spark, sf_dir), ["created_at", "run_id", "log_id"], 1000)


@registry.add("log_latency", f"WITH {_LOGS} SELECT column_name, count(*) AS n, round(avg(latency_ms), 6) AS avg_latency FROM logs WHERE latency_ms IS NOT NULL GROUP BY 1")
def log_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.latency(_logs(spark, sf_dir), "column_name", "latency_ms")


@registry.add("runs_by_file", f"WITH {_RUNS} SELECT * FROM runs WHERE file_id = (SELECT min(file_id) FROM runs) ORDER BY started_at DESC, run_id")
def runs_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _runs(spark, sf_dir)
    first = found.agg(F.min("file_id").alias("file_id"))
    return found.join(F.broadcast(first), "file_id").orderBy(F.desc("started_at"), "run_id")  # one row


@registry.add(
    "run_latest_status",
    "SELECT user_id, ts, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
)
def run_latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.latest(_events(spark, sf_dir).select("user_id", "ts", "event_id", "event_type"), ["user_id"], "ts", ["event_id"])


_CHECKPOINTS = "checkpoints AS (SELECT user_id % 8 AS worker_id, user_id AS run_id, event_id AS last_offset, ts AS updated_at FROM events)"


def _checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select((F.col("user_id") % 8).alias("worker_id"), F.col("user_id").alias("run_id"), F.col("event_id").alias("last_offset"), F.col("ts").alias("updated_at"))


@registry.add(
    "checkpoint_upsert",
    f"WITH {_CHECKPOINTS} SELECT worker_id, run_id, last_offset, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY worker_id, run_id ORDER BY updated_at DESC, last_offset DESC) AS r FROM checkpoints) WHERE r = 1",
)
def checkpoint_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.latest(_checkpoints(spark, sf_dir), ["worker_id", "run_id"], "updated_at", ["last_offset"])


@registry.add("checkpoint_latest", f"WITH {_CHECKPOINTS} SELECT worker_id, max(updated_at) AS updated_at, count(*) AS n FROM checkpoints GROUP BY 1")
def checkpoint_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checkpoints(spark, sf_dir).groupBy("worker_id").agg(F.max("updated_at").alias("updated_at"), F.count("*").alias("n"))


@registry.add(
    "ttl_filter",
    "SELECT event_id, user_id, expires_at FROM (SELECT *, ts + to_seconds(event_id % 7 * 86400) AS expires_at FROM events) WHERE expires_at > (SELECT max(ts) FROM events)",
)
def ttl_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    now = events.agg(F.max("ts")).scalar()
    kept = events.withColumn("expires_at", F.col("ts") + F.make_dt_interval(days=F.col("event_id").cast("int") % 7))
    return runs.unexpired(kept, "expires_at", now).select("event_id", "user_id", "expires_at")


@registry.add(
    "migrate_logs",
    f"""WITH {_RUNS}, {_LOGS} SELECT log_id, run_id, (SELECT '["' || selected_column || '"]' FROM runs WHERE runs.run_id = logs.run_id) AS selected_columns,
        (SELECT selected_column FROM runs WHERE runs.run_id = logs.run_id) AS column_name FROM logs""",
)
def migrate_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _runs(spark, sf_dir)
    moved = runs.migrated_logs(_logs(spark, sf_dir).drop("column_name"), old)
    return moved.join(runs.migrated_runs(old).select("run_id", "selected_columns"), "run_id", "left").select("log_id", "run_id", "selected_columns", "column_name")


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.parquet(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("position"), F.col("n_name").alias("column_name"))


_ASSIGNED = """assigned AS (SELECT n_nationkey AS position, n_name AS column_name, n_nationkey // CAST(ceil((SELECT count(*) FROM nation) / 4) AS INT) AS worker FROM nation)"""


@registry.add("worker_assign", f"WITH {_ASSIGNED} SELECT * FROM assigned")
def worker_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.assign(_nations(spark, sf_dir), 4)


@registry.add(
    "worker_redistribute",
    f"""WITH {_ASSIGNED}, lost AS (SELECT *, row_number() OVER (ORDER BY position) - 1 AS i FROM assigned WHERE worker = 1),
        others AS (SELECT worker, row_number() OVER (ORDER BY worker) - 1 AS part FROM (SELECT DISTINCT worker FROM assigned WHERE worker <> 1))
        SELECT position, column_name, worker FROM assigned WHERE worker <> 1
        UNION ALL SELECT l.position, l.column_name, o.worker FROM lost l JOIN others o ON o.part = (l.i // CAST(ceil((SELECT count(*) FROM lost) / (SELECT count(*) FROM others)) AS INT)) % (SELECT count(*) FROM others)""",
)
def worker_redistribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.redistribute(runs.assign(_nations(spark, sf_dir), 4), 1)


@registry.add("run_progress", "SELECT user_id % 8 AS run, round(avg(event_id % 101) / 100, 6) AS progress FROM events GROUP BY 1")
def run_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy((F.col("user_id") % 8).alias("run")).agg(F.round(F.avg(F.col("event_id") % 101) / 100, 6).alias("progress"))


@registry.add("progress_eta", "SELECT count(*) AS processed, round(count(*) * 100 / 1000000, 6) AS percentage, CAST(floor(greatest(1000000 - count(*), 0) / 250.0) AS BIGINT) AS eta_seconds FROM events WHERE event_type = 'view'")
def progress_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _events(spark, sf_dir).where("event_type = 'view'").groupBy("user_id").agg(F.count("*").alias("n"))
    return runs.progress(done, F.lit(1_000_000), F.lit(250.0))


_GAPS = """SELECT user_id, since, until FROM (SELECT user_id, ts AS until, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS since FROM events)
   WHERE floor(epoch(until)) - floor(epoch(since)) > {}"""


@registry.add("stale_heartbeat", _GAPS.format(86400))
def stale_heartbeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.gaps(_events(spark, sf_dir), "user_id", "ts", 86400)


@registry.add(
    "stale_streams",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
       s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
       SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, session""",
)
def stale_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.sessions(_events(spark, sf_dir), "user_id", "ts", 6 * 3600)


@registry.add("latency_histogram", " UNION ALL ".join(f"SELECT {b}::DOUBLE AS le, count(*) FILTER (WHERE value / 100 <= {b}) AS n FROM events" for b in runs.LATENCY_BUCKETS))
def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.histogram(_events(spark, sf_dir), F.col("value") / 100)


@registry.add(
    "slo_status",
    """WITH h AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS requests, round(avg(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END), 6) AS error_rate, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1)
       SELECT *, error_rate <= 0.01 AND p95 <= 500 AS compliant FROM h""",
)
def slo_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.service_status(_events(spark, sf_dir), "ts", F.col("event_type") == "error", F.col("value"))


@registry.add(
    "perf_regression",
    """SELECT event_type AS operation, round(avg(value), 6) AS average, b.baseline, round(avg(value) / b.baseline, 6) AS ratio, avg(value) / b.baseline > 1.2 AS regressed
       FROM events JOIN (VALUES ('view', 50.0::DOUBLE), ('click', 40.0::DOUBLE), ('purchase', 30.0::DOUBLE)) b(name, baseline) ON b.name = event_type GROUP BY event_type, b.baseline""",
)
def perf_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    baselines = spark.createDataFrame([("view", 50.0), ("click", 40.0), ("purchase", 30.0)], "operation string, baseline double")
    return runs.regressions(_events(spark, sf_dir).select(F.col("event_type").alias("operation"), F.col("value").alias("duration")), baselines)


@registry.add(
    "health_rollup",
    """WITH h AS (SELECT date_trunc('hour', ts) AS hour, event_type, max(value) <= 99 AS healthy FROM events GROUP BY 1, 2)
       SELECT hour, count(*) AS components, coalesce(string_agg(CASE WHEN NOT healthy THEN event_type END, ',' ORDER BY event_type), '') AS unhealthy,
         CASE WHEN bool_and(healthy) THEN 'healthy' ELSE 'degraded' END AS status FROM h GROUP BY 1""",
)
def health_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each hour's kinds of events as components, which are healthy if no value is above 99."""
    parts = _events(spark, sf_dir).groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg((F.max("value") <= 99).alias("healthy"))
    return runs.health(parts, "hour", "event_type", F.col("healthy"))


@registry.add(
    "cache_use",
    """WITH a AS (SELECT user_id, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) <= 36000 AS fresh FROM events)
       SELECT user_id, count(*) FILTER (WHERE fresh) AS hits, count(*) FILTER (WHERE fresh IS NOT TRUE) AS misses, count(*) FILTER (WHERE NOT fresh) AS expired FROM a GROUP BY 1""",
)
def cache_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.cache_use(_events(spark, sf_dir), "user_id", "ts", 36000)


@registry.add("store_append", "SELECT event_type, count(*) AS n, max(event_id) AS last FROM events GROUP BY 1")
def store_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines added to the store in three writes and read again."""
    with scratch.temporary() as keep:
        path = scratch.new_path(spark, "log-store")
        events = _events(spark, sf_dir)
        for part in range(3):
            runs.append(events.where(F.col("event_id") % 3 == part), path)
        stored = spark.read.schema(events.schema).parquet(path)
        out = keep(scratch.written(stored.groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last")), "log-counts"))
        scratch.drop_path(spark, path)
        return out


@registry.add(
    "store_compacted",
    f"WITH {_CHECKPOINTS} SELECT worker_id, run_id, last_offset, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY worker_id, run_id ORDER BY updated_at DESC, last_offset DESC) AS r FROM checkpoints) WHERE r = 1 AND run_id % 5 <> 0",
)
def store_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoints upserted in three lots, every fifth run's deleted, compacted twice and read as the last one of each."""
    with scratch.temporary() as keep:
        path = scratch.new_path(spark, "checkpoints")
        rows = _checkpoints(spark, sf_dir).select("worker_id", "run_id", "last_offset", "updated_at")
        table = KeptTable(spark, path, rows.schema, ["worker_id", "run_id"], "updated_at", ["last_offset"], parts=4)
        for lot in range(3):
            table.append(rows.where(F.col("last_offset") % 3 == lot))
            if lot:
                table.compact()
        end = rows.agg(F.max("updated_at")).scalar()
        table.delete(rows.where("run_id % 5 = 0").select("worker_id", "run_id").distinct(), end + F.expr("INTERVAL 1 SECOND"))
        table.compact()
        table.vacuum()
        out = keep(scratch.written(table.latest(), "last-checkpoints"))
        scratch.drop_path(spark, path)
        return out
