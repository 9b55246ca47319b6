"""Counters of a running job: what passes a point of a plan is counted on its way, without a scan of its own."""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from sablefin.operators.runs import LATENCY_BUCKETS


def _counters(value: Column, buckets: list[float]) -> list[Column]:
    inside = [F.count_if(value <= b).alias(f"le_{i}") for i, b in enumerate(buckets)]
    return [F.count("*").alias("rows"), F.count_if(value.isNull()).alias("nulls"), F.coalesce(F.sum(value.cast("double")), F.lit(0.0)).alias("total"), *inside]


def counted(df: DataFrame, name: str, value: Column, buckets: list[float] | None = None) -> DataFrame:
    """``df``, whose rows are counted as they pass: all, those with a null value, the sum, and how many are at most each bound.

    Of a stream the counts of every micro-batch go to the session's listeners, :class:`RunningHistogram` among them.
    """
    return df.observe(name, *_counters(value, buckets or LATENCY_BUCKETS))


def counted_once(df: DataFrame, value: Column, buckets: list[float] | None = None) -> tuple[DataFrame, Observation]:
    """``df`` and what will have been counted of it once an action has run over it; ``get`` waits for that."""
    seen = Observation()
    return df.observe(seen, *_counters(value, buckets or LATENCY_BUCKETS)), seen


class RunningHistogram(StreamingQueryListener):
    """The counters of :func:`counted` of all batches so far, for streams that run. A batch that is told twice counts once.

    Register it with ``spark.streams.addListener`` and ask :meth:`now` at any time.
    """

    def __init__(self, name: str, buckets: list[float] | None = None) -> None:
        self._name, self._buckets = name, buckets or LATENCY_BUCKETS
        self._batches: dict[tuple[str, int], None] = {}
        self._sums = [0.0] * (len(self._buckets) + 3)
        self._guard = threading.Lock()

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        told = event.progress
        row = told.observedMetrics.get(self._name)
        if row is None:
            return
        with self._guard:
            if (str(told.id), told.batchId) not in self._batches:
                self._batches[str(told.id), told.batchId] = None
                self._sums = [a + b for a, b in zip(self._sums, row)]

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        pass

    def now(self) -> dict[str, object]:
        """``batches``, ``rows``, ``nulls``, ``mean`` (null without values) and ``histogram``, pairs of bound and count."""
        with self._guard:
            rows, nulls, total, *inside = self._sums
            some = rows - nulls
            return {"batches": len(self._batches), "rows": int(rows), "nulls": int(nulls), "mean": total / some if some else None, "histogram": list(zip(self._buckets, map(int, inside)))}
