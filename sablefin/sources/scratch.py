"""Tables that a job writes for itself, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from sablefin.errors import SourceError

_scopes = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where it is unset, a local master gets a folder of this machine; on a cluster, whose executors could not read each
    other's, that raises :class:`SourceError`.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    found = found or context.getCheckpointDir()
    if not found:
        if not (context.master or "").startswith("local"):
            raise SourceError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sablefin-checkpoint-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/sablefin-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: cuts lineage and survives lost executors.

    Names and types stay; like those of any file, all columns may then hold nulls as far as their schema tells.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sablefin_path = path
    for made in getattr(_scopes, "stack", [])[-1:]:
        made.append(out)
    return out


def drop_written(df: DataFrame) -> None:
    """Delete what :func:`written` made for ``df``, once nothing reads it any more."""
    path = getattr(df, "_sablefin_path", None)
    if path:
        drop_path(df.sparkSession, path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def temporary() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A scope whose written tables are deleted at its end, but for those handed to the function that it yields.

    What a scope keeps belongs to the scope around it, if there is one.
    """
    stack = _scopes.__dict__.setdefault("stack", [])
    made: list[DataFrame] = []
    kept: list[DataFrame] = []
    stack.append(made)

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        yield keep
    finally:
        stack.pop()
        for table in made:
            if not any(table is k for k in kept):
                drop_written(table)
        if stack:
            stack[-1].extend(kept)
