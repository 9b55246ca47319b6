"""Connected components of a graph that no single machine need hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``edges`` (u long, v long) to rows (node, component): the smallest node reachable.

    Alternating large-star and small-star rounds: each links every neighbour of a node to the smallest one, first
    towards the larger and then towards the smaller ids, until the edges are stars. Every round is two aggregations with
    map-side combine and two equi-joins; its edges are written to the shared folder, so lineage stays short and nothing
    is gathered on the driver but the number of edges and their checksum. Self loops, repeated edges and nulls are
    dropped; without edges the result is empty.
    """
    now = written(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
        .distinct(),
        name,
    )
    mark = _mark(now)
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        after = written(small.where("u <> v").distinct(), name)
        found = _mark(after)
        drop_written(now)
        now = after
        if found == mark:
            break
        mark = found
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
