"""Runs in the background: start, status, cancel; and profiles that are kept for a while."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession

from sablefin.errors import CancelledError, StoreError


@dataclass
class Run:
    """``status`` is running, completed, failed or cancelled."""

    run_id: str
    status: str = "running"
    result: object = None
    error: Exception | None = None
    ended: threading.Event = field(default_factory=threading.Event)


class RunControl:
    """Starts actions as runs whose Spark jobs carry the run's id as a tag, by which they are cancelled."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._runs: dict[str, Run] = {}

    def start(self, action: Callable[[], object]) -> str:
        """Do ``action`` in a thread of its own; the run's id."""
        run = Run(uuid.uuid4().hex)
        self._runs[run.run_id] = run

        def work() -> None:
            self.spark.sparkContext.addJobTag(run.run_id)
            try:
                run.result = action()
                status = "completed"
            except Exception as e:
                run.error, status = e, "failed"
            run.status = status if run.status == "running" else run.status
            run.ended.set()

        InheritableThread(target=work, daemon=True).start()
        return run.run_id

    def _run(self, run_id: str) -> Run:
        if run_id not in self._runs:
            raise StoreError(f"no run {run_id}")
        return self._runs[run_id]

    def status(self, run_id: str) -> str:
        return self._run(run_id).status

    def cancel(self, run_id: str) -> bool:
        """Stop a run's jobs; False if it had ended."""
        run = self._run(run_id)
        if run.status != "running":
            return False
        run.status = "cancelled"
        self.spark.sparkContext.cancelJobsWithTag(run_id)
        return True

    def result(self, run_id: str, seconds: float | None = None) -> object:
        """What the action gave, once it has ended; its error is raised, and :class:`CancelledError` if it was cancelled."""
        run = self._run(run_id)
        if not run.ended.wait(seconds):
            raise TimeoutError(f"run {run_id} goes on")
        if run.status == "cancelled":
            raise CancelledError(run_id)
        if run.error is not None:
            raise run.error
        return run.result


class ProfileCache:
    """Rows of profiles by key for ``seconds``; a profile has a row for each column of a table, so the driver may hold it."""

    def __init__(self, seconds: float = 3600.0, clock: Callable[[], float] = time.monotonic):
        self.seconds, self._clock = seconds, clock
        self._held: dict[str, tuple[float, list]] = {}
        self.hits = self.misses = 0

    def get(self, key: str, make: Callable[[], DataFrame]) -> list:
        """The rows kept for ``key``, or those of ``make``, which are then kept."""
        found = self._held.get(key)
        if found and self._clock() - found[0] < self.seconds:
            self.hits += 1
            return found[1]
        self.misses += 1
        rows = make().collect()
        self._held[key] = (self._clock(), rows)
        return rows

    def invalidate(self, key: str | None = None) -> None:
        """Drop what is kept for a key, or all."""
        self._held.clear() if key is None else self._held.pop(key, None)
