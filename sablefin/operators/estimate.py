"""Estimates of run time and cost from what earlier runs took."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# How much longer a kind of analysis takes, tokens for a cell, cost of a thousand tokens, cells a second.
MULTIPLIERS = {"sentiment": 1.0, "entity": 1.5, "classification": 0.8}
TOKENS_PER_CELL = {"sentiment": 10, "entity": 25, "classification": 8}
OTHER_TOKENS, COST_PER_1K, CELLS_PER_SECOND = 15, 0.10, 100.0


def _lookup(table: dict, chain: Column, other: float) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for item in table.items() for x in item))[F.lower(chain)], F.lit(other))


def multiplier(chain: Column) -> Column:
    return _lookup(MULTIPLIERS, chain, 1.0)


def tokens(rows: Column, columns: Column, chain: Column) -> Column:
    return rows * columns * _lookup(TOKENS_PER_CELL, chain, OTHER_TOKENS)


def cost(rows: Column, columns: Column, chain: Column) -> Column:
    return tokens(rows, columns, chain) / 1000 * COST_PER_1K


def default(requests: DataFrame) -> DataFrame:
    """``requests`` (rows, columns, chain_type) with seconds, lower and upper at the default rate."""
    seconds = F.floor(F.col("rows") * F.col("columns") / (CELLS_PER_SECOND / multiplier(F.col("chain_type"))))
    out = requests.withColumn("seconds", seconds)
    return out.withColumn("lower", F.floor(F.col("seconds") * 0.5)).withColumn("upper", F.floor(F.col("seconds") * 2.0))


def regression(requests: DataFrame, samples: DataFrame) -> DataFrame:
    """``requests`` with estimates from earlier runs' (chain_type, rows, columns, elapsed_ms) rates of the same kind.

    Bounds are a standard deviation of the rates away; without runs of the kind all three are null.
    """
    rate = F.col("rows") * F.col("columns") / (F.col("elapsed_ms") / 1000)
    rates = samples.where("elapsed_ms > 0").groupBy("chain_type").agg(F.avg(rate).alias("rate"), F.stddev_pop(rate).alias("spread"))
    joined = requests.join(rates, "chain_type", "left")
    adjusted = F.col("rate") / multiplier(F.col("chain_type"))
    out = joined.withColumn("seconds", F.floor(F.col("rows") * F.col("columns") / adjusted)).withColumn("factor", F.col("spread") / adjusted)
    out = out.withColumn("lower", F.floor(F.greatest(F.col("seconds") * (1 - F.col("factor")), F.lit(0.0)))).withColumn("upper", F.floor(F.col("seconds") * (1 + F.col("factor"))))
    return out.select(*requests.columns, "seconds", "lower", "upper")


#: Finished runs of a kind that rates are taken from.
SAMPLE_RUNS = 1000


def recent(history: DataFrame, order: list[str], most: int = SAMPLE_RUNS) -> DataFrame:
    """The last ``most`` rows of each kind by ``order``, whose columns must tell a kind's rows apart."""
    place = F.row_number().over(Window.partitionBy("chain_type").orderBy(*(F.desc(c) for c in order)))
    return history.withColumn("__place", place).where(F.col("__place") <= most).drop("__place")


def recorded(history: DataFrame, actual: DataFrame) -> DataFrame:
    """``history`` with the actual seconds of runs (id, actual_seconds) that have ended; those that had some keep theirs."""
    ended = actual.groupBy("id").agg(F.max("actual_seconds").alias("__ended"))
    joined = history.join(ended, "id", "left")
    return joined.withColumn("actual_seconds", F.coalesce("actual_seconds", "__ended")).select(*history.columns)


def kept(history: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """The history without what is older than ``days``."""
    return history.where(F.col("created_at") >= now - F.expr(f"INTERVAL {days} DAYS"))


def similar(history: DataFrame, rows: int, columns: int, chain: str, now: Column, k: int = 5, days: int = 30) -> DataFrame:
    """The k runs of a kind in the last days that are nearest in rows and columns, with their distance."""
    away = F.abs(F.col("row_count") - rows) + F.abs(F.col("column_count") - columns)
    recent = history.where((F.col("chain_type") == chain) & (F.col("created_at") > now - F.expr(f"INTERVAL {days} DAYS")))
    return recent.withColumn("distance", away).orderBy("distance", "id").limit(k)


def _ratio(a: float, b: Column) -> Column:
    return F.least(F.lit(float(a)) / b, b / F.lit(float(a)))


def historical(runs: DataFrame, rows: int, columns: int) -> DataFrame:
    """One row (seconds, lower, upper) from similar runs, weighted by how similar they are; nulls without any."""
    weight = _ratio(rows, F.col("row_count")) * _ratio(columns, F.col("column_count"))
    done = F.col("actual_seconds").isNotNull()
    held = runs.withColumn("w", F.when(done, weight)).withColumn("t", F.col("actual_seconds").cast("double"))
    once = held.agg(
        F.sum(F.col("t") * F.col("w")).alias("weighted"), F.sum("w").alias("all"), F.count("*").alias("n"), F.sum("t").alias("total"), F.sum(F.col("t") * F.col("t")).alias("squares"), F.count("t").alias("known")
    )
    seconds = F.floor(F.when(F.col("all") > 0, F.col("weighted") / F.col("all")).otherwise(F.try_divide(F.col("total"), F.col("n"))))
    out = once.withColumn("seconds", seconds)
    # The sum of squared distances from the estimate, written out.
    spread = F.sqrt(F.greatest((F.col("squares") - 2 * F.col("seconds") * F.col("total") + F.col("known") * F.col("seconds") * F.col("seconds")) / F.col("n"), F.lit(0.0)))
    out = out.withColumn("spread", spread)
    return out.select("seconds", F.floor(F.greatest(F.col("seconds") - F.col("spread"), F.lit(0.0))).alias("lower"), F.floor(F.col("seconds") + F.col("spread")).alias("upper"))


def accuracy(history: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """One row (total, average, median) of the relative errors of finished runs."""
    error = F.abs(F.col("actual_seconds") - F.col("estimated_seconds")) / F.col("estimated_seconds")
    done = history.where(F.col("actual_seconds").isNotNull() & (F.col("created_at") > now - F.expr(f"INTERVAL {days} DAYS"))).select(error.alias("e"))
    return done.agg(F.count("*").alias("total"), F.round(F.avg("e"), 6).alias("average"), F.round(F.expr("percentile_cont(0.5) WITHIN GROUP (ORDER BY e)"), 6).alias("median"))


def dispatch(requests: DataFrame, samples: DataFrame, history: DataFrame) -> DataFrame:
    """``requests`` with the best estimate there is and its ``method``: the mean of runs with the same rows and columns, or
    the regression, or the default. Each request keeps its row, repeated ones and those with nulls, too."""
    same = history.where("actual_seconds IS NOT NULL").groupBy("chain_type", F.col("row_count").alias("rows"), F.col("column_count").alias("columns"))
    same = same.agg(F.floor(F.avg("actual_seconds")).alias("seen"))
    fitted = regression(requests, samples).withColumnRenamed("seconds", "fitted").drop("lower", "upper")
    joined = default(fitted).withColumnRenamed("seconds", "plain").join(same, ["chain_type", "rows", "columns"], "left")
    method = F.when(F.col("seen").isNotNull(), "historical").when(F.col("fitted").isNotNull(), "regression").otherwise("default")
    return joined.select(*requests.columns, F.coalesce("seen", "fitted", "plain").alias("seconds"), method.alias("method"))
