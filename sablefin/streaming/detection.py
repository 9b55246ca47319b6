"""Structured Streaming: tokenise lines and detect personal data as files arrive."""

from __future__ import annotations

from collections import deque
from functools import reduce
from operator import add
from statistics import fmean, pvariance

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sablefin.functions.patterns import LIBRARY, TEXT_RULES
from sablefin.operators.detect import match_count
from sablefin.operators.sampling import MAX_VARIANCE, STREAM_WINDOW, THRESHOLD, confidence_of, with_stop
from sablefin.operators.tokenise import tokenise_text
from sablefin.sources.scratch import new_path


def lines(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A folder of text files as a stream of lines; Spark's reader splits at line ends whatever the chunk."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)


def tokenise_lines(
    spark: SparkSession, source: str, target: str, rules: list[tuple[str, str]] = TEXT_RULES, most_bytes: int | None = None, most_matches: int | None = None
) -> StreamingQuery:
    """Tokenise what lies in a folder into another one, exactly once; the query ends when all of it is read.

    Lines leave the system here, so by default none is too long and none has too many matches to be tokenised.
    """
    done = lines(spark, source).select(tokenise_text(F.col("value"), rules, most_bytes, most_matches).alias("value"))
    writer = done.writeStream.format("text").option("checkpointLocation", new_path(spark, "stream-checkpoint"))
    return writer.trigger(availableNow=True).start(target)


def detect_stream(
    stream: DataFrame,
    columns: list[str],
    window: int = STREAM_WINDOW,
    threshold: float = THRESHOLD,
    max_rows: int | None = None,
    library: dict[str, list[str]] = LIBRARY,
    results: str | None = None,
    checkpoint: str | None = None,
) -> DataFrame:
    """Rows of progress with ``should_stop`` for each micro-batch until detection settles, rows reach ``max_rows`` or the
    stream ends.

    What has been found so far is a running aggregate in the state store, one row whatever has been read, and each micro-batch
    leaves one row of results that is computed from it: a batch costs what it holds. The row is replaced if the batch runs again, so
    nothing counts twice after a failure. With ``results`` and ``checkpoint`` (folders) a later call goes on where this one
    ended.
    """
    spark = stream.sparkSession
    path = results or new_path(spark, "stream-results")
    settled: deque[float] = deque(maxlen=window)
    state = {"stop": False}

    def each(batch: DataFrame, number: int) -> None:
        if state["stop"]:
            return
        found = batch.select(F.lit(number).cast("long").alias("id"), *so_far(columns, library)).first()
        if found is None:  # a batch without rows
            return
        spark.createDataFrame([found], _RESULT).write.mode("overwrite").parquet(f"{path}/batch={number}")
        settled.append(found["confidence"])
        high = len(settled) == window and fmean(settled) >= threshold and pvariance(settled) < MAX_VARIANCE
        state["stop"] = high or (max_rows is not None and found["rows_processed"] >= max_rows)

    writer = running_counts(stream, columns, library).writeStream.outputMode("update").foreachBatch(each)
    query = writer.option("checkpointLocation", checkpoint or new_path(spark, "stream-checkpoint")).trigger(availableNow=True).start()
    while query.isActive:
        if query.awaitTermination(1) or state["stop"]:
            break
    query.stop()
    held = spark.read.schema(f"{_RESULT}, batch long").option("basePath", path).parquet(f"{path}/batch=*")
    return with_stop(held.drop("batch").withColumnRenamed("id", "batch"), window, threshold)


_RESULT = "id long, rows_processed long, patterns_found long, kinds long, columns long, confidence double"


def running_counts(stream: DataFrame, columns: list[str], library: dict[str, list[str]] = LIBRARY) -> DataFrame:
    """One row of a stream's matches so far, a column for each column and kind, and its ``rows``; tasks add up before they meet."""
    sums = [F.coalesce(F.sum(match_count(F.col(c).cast("string"), r)), F.lit(0)).alias(f"{c}|{t}") for c in columns for t, r in library.items()]
    return stream.agg(*sums, F.count("*").alias("rows"))


def so_far(columns: list[str], library: dict[str, list[str]] = LIBRARY) -> list[Column]:
    """Rows, matches, kinds, columns and confidence of the row of :func:`running_counts`."""
    total = lambda names: reduce(add, (F.col(f"`{c}|{t}`") for c, t in names))
    kinds = reduce(add, ((total((c, t) for c in columns) > 0).cast("long") for t in library))
    filled = reduce(add, ((total((c, t) for t in library) > 0).cast("long") for c in columns))
    found = total((c, t) for c in columns for t in library)
    score = F.round(confidence_of(found, F.col("rows"), kinds, filled), 6)
    return [F.col("rows").alias("rows_processed"), found.alias("patterns_found"), kinds.alias("kinds"), filled.alias("columns"), score.alias("confidence")]


def clicks_by_window(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Rows (start, event_type, n, total) of an event stream in event time; rows later than ``late`` are dropped."""
    by = events.withWatermark("ts", late).groupBy(F.window("ts", width)["start"].alias("start"), "event_type")
    return by.agg(F.count("*").alias("n"), F.sum("value").alias("total"))
