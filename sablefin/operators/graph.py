"""Similarity of vectors and sets, graphs of columns, ranks, and exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sablefin.errors import DimensionError, ValidationError
from sablefin.sources.scratch import drop_written, temporary, written
from sablefin.sources.workers import reach_package

from .cells import similar_pairs

DAMPING, TOLERANCE = 0.85, 1e-4
#: Queries, and bytes of their vectors, that are sent to every executor at once; more are searched for in blocks.
MAX_QUERIES, QUERY_BYTES = 100_000, 128 << 20
#: Queries whose distances from a batch of rows are held at once.
QUERY_CHUNK = 1024
#: Edges of a graph that is written as one text.
MAX_EDGES = 100_000


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of other lengths, without elements or of length 0."""
    fit = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(fit, F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))).otherwise(F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def normalised(a: Column) -> Column:
    """The vector at length 1; one of length 0 as it is."""
    size = norm(a)
    return F.when(size > 0, F.transform(a, lambda x: x.cast("double") / size)).otherwise(F.transform(a, lambda x: x.cast("double")))


def jaccard(a: Column, b: Column) -> Column:
    """Of sets: 1 if both are empty, 0 if one is."""
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def combined(cosine_of: Column, jaccard_of: Column, cosine_weight: float = 0.7, jaccard_weight: float = 0.3) -> Column:
    return cosine_of * cosine_weight + jaccard_of * jaccard_weight


#: Nodes whose pairs are all compared: the columns of a schema.
MAX_NODES = 20_000


def pairs(nodes: DataFrame) -> DataFrame:
    """Rows (a, b, ...) of all two nodes with a < b, for graphs of columns: as many nodes as a schema has columns.

    The columns of ``nodes`` other than ``id`` come twice, with ``_a`` and ``_b`` behind their names. More than ``MAX_NODES``
    nodes raise :class:`ValidationError`: similar ones among them are found by :func:`similarity_graph`.
    """
    if nodes.limit(MAX_NODES + 1).count() > MAX_NODES:
        raise ValidationError(f"more than {MAX_NODES} nodes")
    left = nodes.select(F.col("id").alias("a"), *(F.col(c).alias(f"{c}_a") for c in nodes.columns if c != "id"))
    right = nodes.select(F.col("id").alias("b"), *(F.col(c).alias(f"{c}_b") for c in nodes.columns if c != "id"))
    return left.join(right, F.col("a") < F.col("b"))


def similarity_graph(nodes: DataFrame, vector: str = "embedding", threshold: float = 0.4) -> DataFrame:
    """Edges (src, dst, weight) between nodes whose vectors' cosine is at least ``threshold``.

    Up to ``MAX_NODES`` nodes, as of columns, are all compared. Of more nodes only those meet whose vectors may be similar
    (:func:`sablefin.operators.cells.similar_pairs`), where nodes with equal vectors count as the one with the smallest id; a
    threshold of 0 or less, under which all pairs would be edges, raises :class:`ValidationError` then.
    """
    if nodes.limit(MAX_NODES + 1).count() > MAX_NODES:
        if threshold <= 0:
            raise ValidationError(f"more than {MAX_NODES} nodes")
        return written(similar_pairs(nodes.select("id", vector), threshold, vector), "similar")
    found = pairs(nodes.select("id", vector)).withColumn("weight", cosine(F.col(f"{vector}_a"), F.col(f"{vector}_b")))
    return prune(found.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight"), threshold)


def prune(edges: DataFrame, threshold: float) -> DataFrame:
    return edges.where(F.col("weight") >= threshold)


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge (src, dst, weight) from either end; a loop stays one row."""
    return edges.select("src", "dst", "weight").union(edges.where("src <> dst").select("dst", "src", "weight"))


def neighbours(edges: DataFrame) -> DataFrame:
    """Rows (node, neighbours): what each node is linked to, sorted and joined."""
    names = F.array_join(F.sort_array(F.collect_set("dst")).cast("array<string>"), ",")
    return both_ways(edges).groupBy(F.col("src").alias("node")).agg(names.alias("neighbours"))


def centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (id, centrality): the sum of a node's edge weights by the number of other nodes."""
    sums = both_ways(edges).groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("sum"))
    others = nodes.agg((F.count("*") - 1).alias("others"))
    score = F.coalesce(F.try_divide(F.coalesce("sum", F.lit(0.0)), F.col("others")), F.lit(0.0))
    return nodes.select("id").join(sums, "id", "left").crossJoin(F.broadcast(others)).select("id", score.alias("centrality"))  # one row


def metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row (nodes, edges, density, avg_degree)."""
    one = nodes.agg(F.count("*").alias("nodes")).crossJoin(edges.agg(F.count("*").alias("edges")))  # one row each
    n, e = F.col("nodes"), F.col("edges")
    density = F.coalesce(F.try_divide(e, n * (n - 1) / 2), F.lit(0.0))
    return one.select("nodes", "edges", F.round(density, 6).alias("density"), F.round(F.coalesce(F.try_divide(2.0 * e, n), F.lit(0.0)), 6).alias("avg_degree"))


def pagerank(nodes: DataFrame, links: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE, most: int = 100, normalise: bool = True) -> DataFrame:
    """Rows (id, rank) along links (src, dst, share): a node hands ``share`` of its rank on, and starts with 1 by the number.

    Every five rounds the largest change is looked at. What nodes without links have is not dealt out again. Each round is one
    join and one aggregation with map-side combine, and ranks are written every five rounds, so lineage stays short.
    """
    total = nodes.count()
    with temporary() as keep:
        ranks = keep(_ranked_by_joins(nodes, links, total, damping, tolerance, most))
    if not normalise:
        return ranks
    return ranks.crossJoin(F.broadcast(ranks.agg(F.sum("rank").alias("all")))).select("id", (F.col("rank") / F.col("all")).alias("rank"))  # one row


def _ranked_by_joins(nodes: DataFrame, links: DataFrame, total: int, damping: float, tolerance: float, most: int) -> DataFrame:
    links = written(links, "links")
    ids = written(nodes.select("id").distinct(), "nodes")
    ranks = ids.withColumn("rank", F.lit(1.0 / max(total, 1)))
    kept = None
    for i in range(1, most + 1):
        before = ranks
        sums = ranks.join(links, ranks["id"] == links["src"]).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        ranks = ids.join(sums, ids["id"] == sums["dst"], "left").select("id", ((1 - damping) / max(total, 1) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if i % 5 == 0 or i == most:
            ranks = written(ranks, "ranks")
            change = ranks.join(before.withColumnRenamed("rank", "old"), "id").agg(F.max(F.abs(F.col("rank") - F.col("old")))).first()[0]
            if kept is not None:
                drop_written(kept)
            kept = ranks
            if change is None or change < tolerance:
                break
    return ranks


def undirected_links(edges: DataFrame) -> DataFrame:
    """Links (src, dst, share) that share a node's rank alike among its edges; parallel edges count each."""
    ways = edges.select("src", "dst").union(edges.select("dst", "src"))
    degrees = ways.groupBy("src").agg(F.count("*").alias("degree"))
    return ways.join(degrees, "src").groupBy("src", "dst").agg(F.sum(1.0 / F.col("degree")).alias("share"))


def weighted_links(edges: DataFrame) -> DataFrame:
    """Links (src, dst, share) along the edges' direction, in proportion to their weights."""
    out = edges.groupBy("src").agg(F.sum("weight").alias("out"))
    return edges.join(out, "src").groupBy("src", "dst").agg(F.sum(F.col("weight") / F.col("out")).alias("share"))


def top(df: DataFrame, by: str, key: list[str], k: int) -> DataFrame:
    """The k rows with the largest ``by``; of equals those with the smallest key."""
    return df.orderBy(F.desc(by), *key).limit(k)


def _small(edges: DataFrame) -> DataFrame:
    if edges.limit(MAX_EDGES + 1).count() > MAX_EDGES:
        raise ValidationError(f"more than {MAX_EDGES} edges in one text")
    return edges


def to_dot(edges: DataFrame) -> DataFrame:
    """One row (dot): an undirected graph in DOT, its edges in order. For graphs that people look at: more than ``MAX_EDGES``
    edges raise :class:`ValidationError`."""
    edges = _small(edges)
    line = F.format_string('  "%s" -- "%s" [label="%.2f", weight=%.2f];', F.col("src").cast("string"), F.col("dst").cast("string"), "weight", "weight")
    rows = edges.select(F.struct("src", "dst", line.alias("line")).alias("e")).agg(F.sort_array(F.collect_list("e")).alias("es"))
    return rows.select(F.concat(F.lit("graph G {\n"), F.array_join("es.line", "\n"), F.lit("\n}")).alias("dot"))


def to_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row (json): nodes and edges of a small graph; more than ``MAX_EDGES`` of either raise :class:`ValidationError`."""
    nodes, edges = _small(nodes), _small(edges)
    left = nodes.agg(F.sort_array(F.collect_list("id")).alias("nodes"))
    right = edges.agg(F.sort_array(F.collect_list(F.struct("src", "dst", F.round("weight", 6).alias("weight")))).alias("edges"))
    return left.crossJoin(right).select(F.to_json(F.struct("nodes", "edges")).alias("json"))  # one row each


def from_json(df: DataFrame, id_type: str = "int") -> DataFrame:
    """Edges (src, dst, weight) of what :func:`to_json` gave."""
    schema = f"struct<nodes:array<{id_type}>,edges:array<struct<src:{id_type},dst:{id_type},weight:double>>>"
    return df.select(F.explode(F.from_json("json", schema)["edges"]).alias("e")).select("e.*")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows (query_id, place, id, distance): the k nearest rows by Euclidean distance, exactly; of equals the smallest id.

    Queries are counted and sent to the executors in blocks of at most ``MAX_QUERIES`` and about ``QUERY_BYTES``. Each
    partition keeps its best k for each query, which are at most k rows for each query and partition, of which the best k
    are taken. Vectors of another length than the queries' raise :class:`DimensionError`; rows with a null id or vector are
    passed over; without rows or queries there is no result.
    """
    reach_package(vectors.sparkSession)
    wanted = queries.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    count, least, most = wanted.agg(F.count("*"), F.min(F.size("v")), F.max(F.size("v"))).first()
    if least != most:
        raise DimensionError(f"queries of lengths {least} to {most}")
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    blocks = max(-(-count // MAX_QUERIES), -(-count * 8 * (most or 0) // QUERY_BYTES), 1)
    found = None
    for block in range(blocks):
        own = wanted if blocks == 1 else wanted.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block)
        some = _nearest_to(rows, own, k)
        found = some if found is None else found.union(some)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return found.withColumn("place", place).where(F.col("place") <= k).select("query_id", "place", "id", "distance")


def _nearest_to(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Rows (query_id, id, distance) with each partition's best k for each of the queries.

    Squared distances from a whole batch come out of one matrix product, up to rounding; the distances of what may be among
    the best are then computed exactly.
    """
    held = queries.orderBy("id").toArrow()
    points = held.column("v").combine_chunks().flatten().to_numpy().reshape(held.num_rows, -1) if held.num_rows else np.empty((0, 0))
    shared = rows.sparkSession.sparkContext.broadcast((held.column("id").to_numpy(), points))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, points = shared.value
        best = np.full((len(names), k), np.inf)
        known = np.full((len(names), k), np.iinfo(np.int64).max)
        sizes = (points**2).sum(axis=1)
        for batch in batches:
            if not batch.num_rows or not len(names):
                continue
            ids = batch.column(0).to_numpy()
            lengths = set(np.diff(batch.column(1).offsets.to_numpy()).tolist())
            if lengths != {points.shape[1]}:
                raise DimensionError(f"vectors of length {sorted(lengths)}, queries of length {points.shape[1]}")
            block = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            squares = (block**2).sum(axis=1)
            for at in range(0, len(names), QUERY_CHUNK):
                some = slice(at, at + QUERY_CHUNK)
                about = squares[:, None] - 2 * block @ points[some].T + sizes[some]
                bound = best[some, -1] ** 2
                if len(ids) >= k:
                    bound = np.minimum(bound, np.partition(about, k - 1, axis=0)[k - 1])
                slack = 1e-9 * (squares.max() + sizes[some] + 1)
                row, column = np.nonzero(about <= bound + slack)
                away = np.empty(len(row))
                for part in range(0, len(row), 1 << 16):  # few of all pairs
                    cut = slice(part, part + (1 << 16))
                    away[cut] = np.sqrt(((block[row[cut]] - points[at + column[cut]]) ** 2).sum(axis=1))
                width = len(best[some])
                every = np.concatenate((np.repeat(np.arange(width), k), column))
                distance, name = np.concatenate((best[some].ravel(), away)), np.concatenate((known[some].ravel(), ids[row]))
                order = np.lexsort((name, distance, every))
                first = np.searchsorted(every[order], np.arange(width))
                taken = order[first[:, None] + np.arange(k)]
                best[some], known[some] = distance[taken], name[taken]
        at, place = np.nonzero(np.isfinite(best))
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(names[at]), pa.array(known[at, place]), pa.array(best[at, place])], names=["query_id", "id", "distance"])

    return rows.mapInArrow(run, "query_id long, id long, distance double")
