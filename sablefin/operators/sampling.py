"""Adaptive sampling: detection over growing parts until it has settled."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sablefin.functions.patterns import LIBRARY, PATTERN_TYPES
from sablefin.sources.scratch import temporary, written

from .detect import match_count

THRESHOLD, MAX_VARIANCE = 0.95, 0.001
ADAPTIVE_WINDOW, STREAM_WINDOW = 3, 5


@dataclass(frozen=True)
class SamplingConfig:
    """Sizes grow from ``least`` by ``factor`` up to ``most`` rows in all."""

    least: int = 1000
    most: int = 100_000
    factor: float = 1.5
    threshold: float = THRESHOLD
    window: int = ADAPTIVE_WINDOW


def batch_counts(df: DataFrame, batch: Column, columns: list[str], library: dict[str, list[str]] = LIBRARY) -> DataFrame:
    """Rows (batch, column_name, pattern_type, matches, rows) of one scan; batches add up like any partial result."""
    sums = [F.sum(match_count(F.col(c).cast("string"), r)).alias(f"{c}|{t}") for c in columns for t, r in library.items()]
    once = df.groupBy(batch.alias("batch")).agg(*sums, F.count("*").alias("rows"))
    turned = F.array(
        *(F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("pattern_type"), F.col(f"`{c}|{t}`").alias("matches")) for c in columns for t in library)
    )
    return once.select("batch", "rows", F.explode(turned).alias("x")).select("batch", "x.*", "rows")


def merged(counts: DataFrame) -> DataFrame:
    """Rows (pattern_type, matches, columns): all batches together."""
    found = counts.where("matches > 0")
    return found.groupBy("pattern_type").agg(F.sum("matches").alias("matches"), F.array_join(F.sort_array(F.collect_set("column_name")), ",").alias("columns"))


def merged_stream(counts: DataFrame) -> DataFrame:
    """Rows (pattern_type, matches, last_confidence): counts add up, of confidences the last batch's counts."""
    per = counts.groupBy("batch", "pattern_type").agg(F.sum("matches").alias("matches"), F.max("rows").alias("rows")).where("matches > 0")
    sure = F.round(F.col("matches") / F.col("rows"), 6)
    return per.groupBy("pattern_type").agg(F.sum("matches").alias("matches"), F.max_by(sure, "batch").alias("last_confidence"))


def confidence_of(matches: Column, rows: Column, kinds: Column, columns: Column) -> Column:
    """Up to 0.5 for matches by row, 0.3 for kinds and 0.2 for columns found."""
    share = F.when(kinds > 0, F.least(F.coalesce(F.try_divide(matches * 100, rows), F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
    score = 0.5 * share + 0.3 * F.least(kinds / len(PATTERN_TYPES), F.lit(1.0)) + 0.2 * F.least(columns / 10, F.lit(1.0))
    return F.least(score, F.lit(1.0))


def progress(counts: DataFrame) -> DataFrame:
    """Rows (batch, rows_processed, patterns_found, kinds, columns, confidence): what is known after each batch.

    Batches are few; what they hold has been added up before.
    """
    first = counts.where("matches > 0")
    so_far = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    per = counts.groupBy("batch").agg(F.max("rows").alias("rows"), F.sum("matches").alias("matches"))
    kinds = first.groupBy("pattern_type").agg(F.min("batch").alias("batch")).groupBy("batch").agg(F.count("*").alias("new_kinds"))
    columns = first.groupBy("column_name").agg(F.min("batch").alias("batch")).groupBy("batch").agg(F.count("*").alias("new_columns"))
    joined = per.join(kinds, "batch", "left").join(columns, "batch", "left")
    run = lambda c: F.sum(F.coalesce(c, F.lit(0))).over(so_far)
    out = joined.select("batch", run("rows").alias("rows_processed"), run("matches").alias("patterns_found"), run("new_kinds").alias("kinds"), run("new_columns").alias("columns"))
    score = confidence_of(F.col("patterns_found"), F.col("rows_processed"), F.col("kinds"), F.col("columns"))
    return out.withColumn("confidence", F.round(score, 6))


def with_stop(progressed: DataFrame, window: int = STREAM_WINDOW, threshold: float = THRESHOLD) -> DataFrame:
    """``progressed`` with ``should_stop``: the last ``window`` confidences are high on average and hardly vary."""
    last = Window.orderBy("batch").rowsBetween(-(window - 1), 0)
    settled = (F.count("*").over(last) == window) & (F.avg("confidence").over(last) >= threshold) & (F.var_pop("confidence").over(last) < MAX_VARIANCE)
    return progressed.withColumn("should_stop", settled)


#: Values that a key's place in the order of parts can have.
PLACES = 1 << 28


def place_of(key: Column) -> Column:
    """A key's place in the order of parts: 28 bits of a hash of the key as text."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 7), 16, 10).cast("long")


def adaptive(df: DataFrame, key: str, columns: list[str], config: SamplingConfig | None = None, library: dict[str, list[str]] = LIBRARY) -> DataFrame:
    """Rows of :func:`progress` with ``should_stop``, from disjoint parts of growing size along a hash of the key.

    Each part is a range of hash values; parts are sized by the number of rows, and the last one ends at ``most``. What all
    parts together may need is written once, so the rows are scanned once, whatever their number. Reading stops at the first
    part after which detection has settled. Rows with a null key are left out.
    """
    config = config or SamplingConfig()
    spark = df.sparkSession
    total = df.count()
    end = min(config.most, total)
    bound = lambda upto: int(upto / total * PLACES) + (upto == total)
    place = place_of(F.col(key)).alias("__place")
    history = None
    with temporary():
        drawn = written(df.select(*columns, place).where(F.col("__place") < bound(end)), "sample") if total else None
        rounds, done, size, found = 0, 0.0, float(config.least), None
        while total and done < end:
            upto = min(done + size, end)
            part = drawn.where((F.col("__place") >= bound(done)) & (F.col("__place") < bound(upto)))
            rows = batch_counts(part, F.lit(rounds), columns, library).collect()  # a row for each column and kind
            held = spark.createDataFrame(rows, _COUNTS)
            found = held if found is None else found.union(held)
            rounds, done, size = rounds + 1, upto, size * config.factor
            history = with_stop(progress(found), config.window, config.threshold)
            if history.where("should_stop").limit(1).count():
                break
    return with_stop(progress(spark.createDataFrame([], _COUNTS)), config.window, config.threshold) if history is None else history


_COUNTS = "batch int, column_name string, pattern_type string, matches long, rows long"


def with_strategy(history: DataFrame, most: int | None = None) -> DataFrame:
    """``history`` with ``strategy``, a label of how far detection had read after each batch: ``EarlyStop`` if it had settled,
    ``Fixed(n)`` if it had read the ``most`` rows it may, ``Progressive`` after the first batch, ``Adaptive`` after others."""
    label = F.when(F.col("should_stop"), F.lit("EarlyStop"))
    if most is not None:
        label = label.when(F.col("rows_processed") >= most, F.lit(f"Fixed({most})"))
    first = F.min("batch").over(Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, 0))  # a row for each batch
    return history.withColumn("strategy", label.when(F.col("batch") == first, F.lit("Progressive")).otherwise(F.lit("Adaptive")))
