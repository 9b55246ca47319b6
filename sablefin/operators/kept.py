"""A table of upserts: rows are appended, read as the last one of each key, and compacted without disturbing readers.

Rows lie in parts by a hash of their key. An append is a folder ``log=n`` with a folder for each part that it touches; a compaction
is a folder ``base=n`` with those parts that had rows since their last base, written anew with one row a key. A part is read
from its newest finished base and the logs behind it, so a reader's files stay as they are until :meth:`KeptTable.vacuum`.
"""

from __future__ import annotations

import re
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sablefin.errors import StoreError

from .runs import latest

_GONE = "__gone"


class KeptTable:
    """The upserts at ``path``, with a ``schema``, whose rows have a ``key`` and a time ``at``; ``tie`` decides between rows of one time.

    One job at a time writes or compacts, any number read. Rows with a null in the key are keys like any other.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: list[str], at: str, tie: list[str] | None = None, parts: int = 16) -> None:
        self._spark, self._path, self._schema = spark, path.rstrip("/"), schema
        self._key, self._at, self._tie, self._parts = key, at, tie or [], parts

    def append(self, df: DataFrame) -> None:
        """Add rows: new keys or newer states of known ones."""
        self._write(df.select(*self._schema.names, F.lit(False).alias(_GONE)), f"log={self._next()}")

    def delete(self, keys: DataFrame, at: Column) -> None:
        """Mark keys as gone from a time on: rows of the key up to then no longer count."""
        values = [F.col(c) if c in self._key else at.cast(self._schema[c].dataType).alias(c) if c == self._at else F.lit(None).cast(self._schema[c].dataType).alias(c) for c in self._schema.names]
        self._write(keys.select(*values, F.lit(True).alias(_GONE)), f"log={self._next()}")

    def latest(self) -> DataFrame:
        """The last row of each key that isn't gone."""
        return self._last(self._rows(self._places())).where(~F.col(_GONE)).drop(_GONE)

    def compact(self, keep: Column | None = None) -> int:
        """Write the parts that had rows since their last base anew, with the last row of each key; how many these were.

        What is gone is left out and, with ``keep``, what doesn't meet it (a time to live, for instance) in these parts.
        """
        places = {p: found for p, found in self._places().items() if len(found) > 1 or not found[0].startswith("base=")}
        if not places:
            return 0
        rows = self._last(self._rows(places)).where(~F.col(_GONE))
        rows = rows if keep is None else rows.where(F.coalesce(keep, F.lit(False)))
        name = f"base={self._next()}"
        self._write(rows, name)
        # A part without a row left must still have its place, or its old rows would come back.
        left = {int(f.removeprefix("part=")) for f in self._names(f"{self._path}/{name}") if f.startswith("part=")}
        for part in set(places) - left:
            self._mkdirs(f"{self._path}/{name}/part={part}")
        return len(places)

    def vacuum(self) -> int:
        """Delete the files that no new reader needs, once the readers of before are done; how many folders these were."""
        needed = {f"{f}/part={p}" for p, found in self._places().items() for f in found}
        gone = 0
        for folder in self._folders():
            inside = {f"{folder}/{x}" for x in self._names(f"{self._path}/{folder}") if x.startswith("part=")}
            for place in inside - needed:
                self._delete(f"{self._path}/{place}")
                gone += 1
            if not inside & needed and folder != self._folders()[-1]:  # the last one stays, so that no number comes twice
                self._delete(f"{self._path}/{folder}")
        return gone

    def _last(self, rows: DataFrame) -> DataFrame:
        return latest(rows, self._key, self._at, [*self._tie, _GONE]).select(*self._schema.names, _GONE)

    def _rows(self, places: dict[int, list[str]]) -> DataFrame:
        schema = StructType([*self._schema.fields]).add(_GONE, "boolean")
        paths = [f"{self._path}/{folder}/part={part}" for part, found in places.items() for folder in found]
        return self._spark.read.schema(schema).parquet(*paths) if paths else self._spark.createDataFrame([], schema)

    def _places(self) -> dict[int, list[str]]:
        """For each part the folders that it is read from: its newest base and the logs behind that."""
        out: dict[int, list[str]] = defaultdict(list)
        for folder in self._folders():
            for part in (int(x.removeprefix("part=")) for x in self._names(f"{self._path}/{folder}") if x.startswith("part=")):
                out[part] = [folder] if folder.startswith("base=") else [*out[part], folder]
        return dict(out)

    def _write(self, df: DataFrame, name: str) -> None:
        part = F.pmod(F.xxhash64(*self._key), F.lit(self._parts))
        df.withColumn("part", part).repartition("part").write.mode("errorifexists").partitionBy("part").parquet(f"{self._path}/{name}")

    def _folders(self) -> list[str]:
        """Finished folders in the order in which they were written; one without the mark of success never counts."""
        found = [x for x in self._names(self._path) if re.fullmatch(r"(log|base)=\d+", x) and "_SUCCESS" in self._names(f"{self._path}/{x}")]
        return sorted(found, key=lambda x: int(x.split("=")[1]))

    def _next(self) -> int:
        return max((int(x.split("=")[1]) for x in self._names(self._path) if re.fullmatch(r"(log|base)=\d+", x)), default=-1) + 1

    def _at_path(self, path: str):  # noqa: ANN202
        place = self._spark._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self._spark._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        place, system = self._at_path(path)
        return [x.getPath().getName() for x in system.listStatus(place)] if system.exists(place) else []

    def _mkdirs(self, path: str) -> None:
        place, system = self._at_path(path)
        if not system.mkdirs(place):
            raise StoreError(path)

    def _delete(self, path: str) -> None:
        place, system = self._at_path(path)
        system.delete(place, True)
