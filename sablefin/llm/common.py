"""What the operators of this subpackage share: tables, written intermediate tables, Arrow buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sablefin.sources.scratch import drop_written, shared_dir, temporary, written
from sablefin.sources.workers import reach_package

__all__ = [
    "bounded_broadcast", "buffers", "cells", "drop_written", "hot_join", "is_held_out", "numbered", "sampled", "shared_dir", "small_batches", "table", "temporary",
    "utf8", "written",
]

#: Rows and bytes that Spark hands to a Python worker at once: many short texts, or a few long ones.
ARROW_ROWS, ARROW_BYTES = 512, 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables of a data folder."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches to ``ARROW_ROWS`` rows and about ``ARROW_BYTES`` bytes, so that a worker holds few whole long texts,
    and let workers import this library. Both settings are the session's and stay."""
    reach_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def utf8(name: str = "text") -> Column:
    """A text column as its UTF-8 bytes; null reads as empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary Arrow column on end, and the n + 1 offsets that cut them into rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    kind = np.int64 if wide else np.int32
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(offsets) else np.empty(0, np.uint8)
    return raw, offsets - (offsets[0] if len(offsets) else 0)


def is_held_out(parts: int, remainder: int, name: str = "doc_id") -> Column:
    """Whether crc32 of an id written as text leaves ``remainder`` when divided by ``parts``."""
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % parts == remainder, F.lit(False))


#: Rows of a few numbers that may be broadcast; how many there are is counted first.
BROADCAST_ROWS = 1 << 18


def bounded_broadcast(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it is counted to have at most ``most`` rows; otherwise as it is, for a shuffle join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: Rows that one key may have in a shuffle join, as long as those with more can be broadcast.
HOT_ROWS = 1 << 9


def hot_join(rows: DataFrame, found: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` joined (inner or left_semi) with ``found``, a written table that has each key once and, in ``many``, how many of
    ``rows`` have it.

    Keys with many rows are broadcast, so that no task gets all rows of a hot key, and the others are joined by shuffle; were
    there too many of them, only those with still more rows are.
    """
    most = HOT_ROWS
    while (count := found.where(F.col("many") > most).limit(BROADCAST_ROWS + 1).count()) > BROADCAST_ROWS:
        most *= 16
    cold = rows.join(found.where(F.col("many") <= most).drop("many"), key, how)
    if not count:
        return cold
    hot = F.broadcast(found.where(F.col("many") > most).drop("many"))
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(found.where(F.col("many") <= most).drop("many"), key, how)
    return rows.join(hot, key, how).union(cold)


def cells(keyed: DataFrame, keys: list[str], item: str, most: int) -> DataFrame:
    """Rows (*keys, a, b, item, n): buckets of ``keyed`` with at least two items, cut into cells of bounded size.

    A bucket above ``most`` items is dealt by hash into parts, and each two parts form a cell (a, b), so that every two
    items of a bucket meet in some cell and no cell is larger than about twice ``most``. A smaller bucket is one cell.
    """
    sizes = keyed.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / most).cast("int")
    sized = keyed.join(sizes, keys).withColumn("parts", parts)
    sized = sized.withColumn("mine", F.pmod(F.xxhash64(item), F.col("parts")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: (x != F.col("mine")) | (F.col("parts") == 1))
    pairs = sized.withColumn("other", F.explode(others))
    return pairs.select(*keys, F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), item, "n")


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` written with a column ``id`` from 1 without gaps, in the order of its partitions and of the rows in them: only the
    partitions' sizes meet in one place."""
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = written(df.withColumn("__part", F.spark_partition_id()).withColumn("__row", row), name)
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__size"))
    before = F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each partition
    starts = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    return placed.join(F.broadcast(starts), "__part").withColumn("id", F.col("__before") + F.col("__row") + 1).drop("__part", "__row", "__size", "__before")


#: Parts of a group that a sample is drawn from, so that no group of rows has to be ordered by one task.
SLOTS = 64


def sampled(rows: DataFrame, documents: dict, most_bytes: int, salt: str) -> dict[object, list[bytes]]:
    """Whole texts (as UTF-8) to learn from, by group, of rows (group, id, text) without nulls in group and text.

    Each group gives about ``documents[group]`` texts at most, those with the smallest hashes of (id, text) in each of
    ``SLOTS`` parts, as far as they fit into ``most_bytes`` together (if none fits, the shortest). So the driver holds no
    more than that for a group, whatever ids repeat and however long texts are; rows alike in id and text count once.
    """
    marked = rows.select("group", "text", F.xxhash64(F.lit(salt), "id", "text").alias("mark"))
    narrow = marked.groupBy("group", "mark").agg(F.first(F.octet_length("text")).alias("bytes"))
    slot = F.pmod("mark", F.lit(SLOTS))
    rank = F.row_number().over(Window.partitionBy("group", slot).orderBy("mark"))
    quota = -(-max(documents.values(), default=0) // SLOTS)
    ranked = narrow.withColumn("rank", rank).where(F.col("rank") <= quota)
    left = {group: [most_bytes, n] for group, n in documents.items()}
    shortest: dict[object, tuple] = {}
    picks = []
    for r in sorted(ranked.select("group", "mark", "bytes").collect(), key=lambda r: (r["mark"], r["bytes"])):
        room = left.get(r["group"], [0, 0])
        shortest[r["group"]] = min(shortest.get(r["group"], (r["bytes"], r["mark"])), (r["bytes"], r["mark"]))
        if r["bytes"] <= room[0] and room[1] > 0:
            room[0], room[1] = room[0] - r["bytes"], room[1] - 1
            picks.append((r["group"], r["mark"]))
    for group in set(shortest) - {g for g, _ in picks}:
        picks.append((group, shortest[group][1]))
    out: dict[object, list[bytes]] = {}
    if not picks:
        return out
    kind = rows.schema["group"].dataType.simpleString()
    wanted = rows.sparkSession.createDataFrame(picks, f"group {kind}, mark long")  # as many rows as were picked
    texts = marked.join(F.broadcast(wanted), ["group", "mark"]).dropDuplicates(["group", "mark"]).select("group", "mark", F.col("text").cast("binary"))
    for group, _, text in sorted(texts.toLocalIterator(), key=lambda r: (r[1], str(r[0]))):
        out.setdefault(group, []).append(bytes(text))
    return out
