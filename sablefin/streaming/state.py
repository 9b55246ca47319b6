"""Streams with keyed state: a token dictionary that outlives restarts, and who is alive."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from sablefin.errors import StreamRowError
from sablefin.functions.patterns import PatternSet
from sablefin.operators import tokenise
from sablefin.sources.workers import reach_package

#: Parts that the dictionary's state is kept in; a part numbers its own originals.
BUCKETS = 64


def keyed_state(spark: SparkSession) -> None:
    """Let the session keep state in RocksDB, which keyed state of several values needs, unless it names another provider."""
    reach_package(spark)
    name = "spark.sql.streaming.stateStore.providerClass"
    plain = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    if spark.conf.get(name, plain).endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class GetOrCreate(StatefulProcessor):
    """For a bucket of originals: the number of each that came before, a new one for each that did not.

    The i-th original of bucket b has the number i * buckets + b, so numbers of all buckets differ; how far a bucket has
    counted is part of its state, so no number is given twice after a restart.
    """

    def __init__(self, buckets: int) -> None:
        self._buckets = buckets

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._known = handle.getMapState("known", "original string", "pattern_type string, number long")
        self._count = handle.getValueState("count", "count long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        told: set[str] = set()
        count = self._count.get()[0] if self._count.exists() else 0
        before = count
        for row in rows:
            if row.original in told:
                continue
            told.add(row.original)
            fresh = not self._known.containsKey((row.original,))
            if fresh:
                kind, number = row.pattern_type, count * self._buckets + key[0]
                self._known.updateValue((row.original,), (kind, number))
                count += 1
            else:
                kind, number = self._known.getValue((row.original,))
            yield Row(original=row.original, pattern_type=kind, number=number, fresh=fresh)
        if count != before:
            self._count.update((count,))

    def close(self) -> None:
        pass


_NUMBERED = "original string, pattern_type string, number long, fresh boolean"


def numbered_originals(stream: DataFrame, text_column: str, patterns: PatternSet, buckets: int = BUCKETS) -> DataFrame:
    """Rows (original, pattern_type, number, fresh): in each micro-batch, every original that its texts hold, once, with the
    number that it has for good; ``fresh`` tells those that no earlier batch had.

    An original has the kind under which it came first. A task hands over each original of a batch of rows once, so a frequent one
    does not fill its bucket.
    """
    keyed_state(stream.sparkSession)
    places = tokenise.places(stream, text_column, patterns).withColumn("bucket", F.pmod(F.xxhash64("original"), F.lit(buckets)).cast("int"))

    def once(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        for batch in batches:
            yield from pa.Table.from_batches([batch]).group_by(batch.schema.names, use_threads=False).aggregate([]).to_batches()

    each = places.select("bucket", "original", "pattern_type").mapInArrow(once, "bucket int, original string, pattern_type string")
    return each.groupBy("bucket").transformWithState(GetOrCreate(buckets), _NUMBERED, "Append", "None")


def tokenise_stream(stream: DataFrame, key: str, text_column: str, patterns: PatternSet, target: str, dictionary: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Tokenise a stream of records into the table ``target`` and keep its dictionary in the table ``dictionary``.

    An original gets one token, in whatever batch, file or run of the query it comes, as long as ``checkpoint`` is the same; it
    is the state there that is asked, not the table, so a batch costs what it holds, however large the dictionary has grown.
    Both tables have a folder for each micro-batch, which is written anew if the batch runs again: nothing counts twice.
    The query ends when all input is read. Records may repeat a key and have null keys and texts.
    """
    numbers = numbered_originals(stream, text_column, patterns, buckets)
    empty = [F.lit(None).cast(kind).alias(name) for name, kind in (x.split() for x in _NUMBERED.split(", "))]
    records = stream.select(F.struct(*stream.columns).alias("record"), *empty)
    both = records.unionByName(numbers, allowMissingColumns=True)

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        token = tokenise.counter_token(F.col("pattern_type"), F.col("number")).alias("token")
        tokens = batch.where("original IS NOT NULL").select("original", "pattern_type", "number", token, "fresh")
        tokens.where("fresh").drop("fresh").write.mode("overwrite").parquet(f"{dictionary}/batch={number}")
        done = tokenise.tokenise(batch.where("record IS NOT NULL").select("record.*"), key, text_column, tokens, patterns)
        done.write.mode("overwrite").parquet(f"{target}/batch={number}")
        batch.unpersist()

    return both.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Heartbeats(StatefulProcessor):
    """For a key: how many events it has sent, when the last one was, and a timer that tells when it has fallen silent."""

    def __init__(self, timeout_ms: int, late_ms: int) -> None:
        self._timeout, self._late = timeout_ms, late_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("state", "last_ms long, events long, late long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        known = self._state.exists()
        before, events, late = self._state.get() if known else (None, 0, 0)
        last = before
        for row in rows:
            if before is not None and row.at_ms < before - self._late:
                late += 1
            events, last = events + 1, row.at_ms if last is None else max(last, row.at_ms)
        self._state.update((last, events, late))
        for timer in list(self._handle.listTimers()):
            self._handle.deleteTimer(timer)
        self._handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self._timeout)
        if not known:
            yield Row(key=key[0], status="live", last_ms=last, events=events, late=late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        last, events, late = self._state.get()
        self._state.clear()  # who comes back begins anew
        yield Row(key=key[0], status="silent", last_ms=last, events=events, late=late)

    def close(self) -> None:
        pass


def liveness(events: DataFrame, key: Column, at: Column, timeout_ms: int, late_ms: int = 0) -> DataFrame:
    """Rows (key, status, last, events, late) of an event stream, one when a key is first heard of (``live``) and one when it has
    been silent for ``timeout_ms`` of wall-clock time (``silent``), after which its state is gone.

    A timer fires without a further event of any key, as the query runs on without input. ``events`` counts all events since
    the key went live, ``late`` those of more than ``late_ms`` before the latest one of earlier batches. Events with a null key
    or time are left out.
    """
    keyed_state(events.sparkSession)
    rows = events.select(key.cast("string").alias("key"), F.unix_millis(at.cast("timestamp")).alias("at_ms")).where("key IS NOT NULL AND at_ms IS NOT NULL")
    told = rows.groupBy("key").transformWithState(Heartbeats(timeout_ms, late_ms), "key string, status string, last_ms long, events long, late long", "Append", "ProcessingTime")
    return told.select("key", "status", F.timestamp_millis("last_ms").alias("last"), "events", "late")


def with_quarantine(
    stream: DataFrame,
    checks: dict[str, Column],
    change: Callable[[DataFrame], DataFrame],
    target: str,
    quarantine: str,
    checkpoint: str,
    continue_on_error: bool = True,
) -> StreamingQuery:
    """Write a stream's rows to the table ``target`` as ``change`` makes them, and those that fail a check to ``quarantine``.

    ``checks`` names conditions that a row must meet; the first that is not true (null included) is the row's ``error``. Both
    tables have a folder for each micro-batch, written anew if the batch runs again, so replays change neither. With
    ``continue_on_error`` off, a failing row ends the query with its error before the batch is written. The query ends when all input is
    read.
    """
    error = F.coalesce(*(F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in checks.items()), F.lit(None).cast("string"))

    def each(batch: DataFrame, number: int) -> None:
        marked = batch.withColumn("error", error).persist()
        bad = marked.where("error IS NOT NULL")
        if not continue_on_error:
            first = bad.select("error").first()
            if first is not None:
                marked.unpersist()
                raise StreamRowError(first["error"])
        bad.write.mode("overwrite").parquet(f"{quarantine}/batch={number}")
        change(marked.where("error IS NULL").drop("error")).write.mode("overwrite").parquet(f"{target}/batch={number}")
        marked.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
