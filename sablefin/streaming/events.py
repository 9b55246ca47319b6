"""Events of running streams for whoever watches: progress, errors, the end."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql.streaming import StreamingQueryListener


class EventSink(StreamingQueryListener):
    """Hands each event of every streaming query on as one line of JSON.

    Register it with ``spark.streams.addListener``. Events have a ``type`` (started, progress, heartbeat, error, complete),
    the query's ``id`` and, for progress, the rows read in the batch and their rate.
    """

    def __init__(self, send: Callable[[str], None]):
        self._send = send

    def _out(self, kind: str, query: object, **more: object) -> None:
        self._send(json.dumps({"type": kind, "id": str(query), **more}, sort_keys=True))

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        self._out("started", event.id)

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        now = event.progress
        self._out("progress", now.id, batch=now.batchId, rows=now.numInputRows, rate=now.processedRowsPerSecond)

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        self._out("heartbeat", event.id)

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        if event.exception:
            self._out("error", event.id, message=str(event.exception)[:1000])
        else:
            self._out("complete", event.id)
