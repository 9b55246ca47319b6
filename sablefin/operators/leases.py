"""One rate for all tasks of a job: the driver hands out the times at which calls may begin."""

from __future__ import annotations

import secrets
import socket
import socketserver
import threading
import time

from pyspark.sql import SparkSession

from sablefin.errors import ScorerError

_lock = threading.Lock()
_server: _Server | None = None


class _Answer(socketserver.StreamRequestHandler):
    def handle(self) -> None:
        said = self.rfile.readline(200).decode("ascii", "replace").split()
        if len(said) == 3 and secrets.compare_digest(said[0], self.server.secret):
            self.wfile.write(f"{self.server.wait(said[1], float(said[2]))!r}\n".encode())


class _Server(socketserver.ThreadingTCPServer):
    allow_reuse_address = daemon_threads = True

    def __init__(self, host: str) -> None:
        super().__init__((host, 0), _Answer)
        self.secret = secrets.token_hex(16)
        self._free: dict[str, float] = {}
        self._guard = threading.Lock()

    def wait(self, name: str, interval: float) -> float:
        """Seconds until the next free place of a quota, which is taken."""
        with self._guard:
            now = time.monotonic()
            start = max(now, self._free.get(name, now))
            self._free[name] = start + interval
            return start - now


class Lease:
    """A quota of ``per_second`` calls for whoever holds a copy, on whatever executor.

    :meth:`take` returns when a call may begin; calls of all holders begin at least 1 / ``per_second`` seconds apart. The driver
    keeps the times; a driver that can't be reached is a :class:`ScorerError`.
    """

    def __init__(self, spark: SparkSession, per_second: float) -> None:
        global _server
        host = spark.conf.get("spark.driver.host", "127.0.0.1")
        with _lock:
            if _server is None:
                _server = _Server(spark.conf.get("spark.driver.bindAddress", host))
                threading.Thread(target=_server.serve_forever, daemon=True).start()
        self._place = host, _server.server_address[1]
        self._secret, self._name, self._interval = _server.secret, secrets.token_hex(8), 1 / per_second

    def take(self) -> None:
        try:
            with socket.create_connection(self._place, timeout=30) as line:
                line.sendall(f"{self._secret} {self._name} {self._interval!r}\n".encode())
                seconds = float(line.makefile().readline())
        except (OSError, ValueError) as e:
            raise ScorerError(f"no lease: {type(e).__name__}") from e
        time.sleep(seconds)
