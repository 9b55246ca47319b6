"""Queries of similarity, graphs, ranks and nearest neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sablefin.operators import cells, features, graph
from sablefin.sources import scratch, tables

from .common import Registry
from .profiling import feature_sql

registry = Registry()

# Nodes: the ten labels of the embeddings, with their mean vector and the set of steps in which their first elements lie.
_NODES_SQL = """dims AS (SELECT label, vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
  means AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM dims GROUP BY 1, 2),
  nodes AS (SELECT label AS id, list(x ORDER BY i) AS v FROM means GROUP BY 1),
  tokens AS (SELECT label AS id, list_sort(list(DISTINCT CAST(floor(CAST(embedding[1] AS DOUBLE) * 40) AS BIGINT))) AS s FROM embeddings GROUP BY 1),
  pairs AS (SELECT a.id AS a, b.id AS b, a.v AS va, b.v AS vb, ta.s AS sa, tb.s AS sb FROM nodes a JOIN nodes b ON a.id < b.id
            JOIN tokens ta ON ta.id = a.id JOIN tokens tb ON tb.id = b.id),
  scored AS (SELECT a, b, list_cosine_similarity(va, vb) AS cosine, len(list_intersect(sa, sb)) / len(list_distinct(list_concat(sa, sb))) AS jaccard FROM pairs)"""


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vector and token set of each label; two aggregations with map-side combine."""
    vectors = tables.parquet(spark, sf_dir, "embeddings")
    dims = vectors.select("label", F.posexplode("embedding").alias("i", "x"))
    means = dims.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    lists = means.groupBy(F.col("label").alias("id")).agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("p")).select("id", F.col("p.x").alias("embedding"))
    step = F.floor(F.get("embedding", F.lit(0)).cast("double") * 40)
    tokens = vectors.groupBy(F.col("label").alias("id")).agg(F.collect_set(step).alias("tokens"))
    return lists.join(tokens, "id")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.pairs(scratch.written(_nodes(spark, sf_dir), "label-nodes"))
    return found.select("a", "b", graph.cosine(F.col("embedding_a"), F.col("embedding_b")).alias("cosine"), graph.jaccard(F.col("tokens_a"), F.col("tokens_b")).alias("jaccard"))


@registry.add("cosine_pairs", f"WITH {_NODES_SQL} SELECT a, b, round(cosine, 6) AS cosine FROM scored")
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("a", "b", F.round("cosine", 6).alias("cosine"))


@registry.add("jaccard_pairs", f"WITH {_NODES_SQL} SELECT a, b, round(jaccard, 6) AS jaccard FROM scored")
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@registry.add("combined_similarity", f"WITH {_NODES_SQL} SELECT a, b, round(0.7 * cosine + 0.3 * jaccard, 6) AS similarity FROM scored")
def combined_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("a", "b", F.round(graph.combined(F.col("cosine"), F.col("jaccard")), 6).alias("similarity"))


_SIMILAR_SQL = f"WITH {_NODES_SQL}, edges AS (SELECT a AS src, b AS dst, cosine AS weight FROM scored WHERE cosine >= 0.0)"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.similarity_graph(scratch.written(_nodes(spark, sf_dir).select("id", "embedding"), "label-nodes"), threshold=0.0)


@registry.add("similarity_graph", f"{_SIMILAR_SQL} SELECT src, dst, round(weight, 6) AS weight FROM edges")
def similarity_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).select("src", "dst", F.round("weight", 6).alias("weight"))


@registry.add("prune_edges", f"{_SIMILAR_SQL} SELECT src, dst, round(weight, 6) AS weight FROM edges WHERE weight >= 0.05")
def prune_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.prune(_edges(spark, sf_dir), 0.05).select("src", "dst", F.round("weight", 6).alias("weight"))


_WAYS = "ways AS (SELECT src, dst, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges WHERE src <> dst)"


@registry.add("neighbors", f"{_SIMILAR_SQL}, {_WAYS} SELECT src AS node, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS neighbours FROM (SELECT DISTINCT src, dst FROM ways) GROUP BY 1")
def neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbours(_edges(spark, sf_dir))


@registry.add(
    "centrality", f"{_SIMILAR_SQL}, {_WAYS} SELECT n.id, round(coalesce(sum(w.weight), 0) / ((SELECT count(*) FROM nodes) - 1), 6) AS centrality FROM nodes n LEFT JOIN ways w ON w.src = n.id GROUP BY 1"
)
def centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = scratch.written(_nodes(spark, sf_dir).select("id", "embedding"), "label-nodes")
    return graph.centrality(nodes, graph.similarity_graph(nodes, threshold=0.0)).select("id", F.round("centrality", 6).alias("centrality"))


@registry.add(
    "rank_columns",
    f"""{_SIMILAR_SQL}, {_WAYS}, c AS (SELECT n.id, coalesce(sum(w.weight), 0) / ((SELECT count(*) FROM nodes) - 1) AS centrality FROM nodes n LEFT JOIN ways w ON w.src = n.id GROUP BY 1)
        SELECT id, round(0.7 * (id / 10) + 0.3 * centrality, 6) AS score FROM c""",
)
def rank_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0.7 of a score of each node's own (its number by ten) and 0.3 of its centrality, best first."""
    nodes = scratch.written(_nodes(spark, sf_dir).select("id", "embedding"), "label-nodes")
    found = graph.centrality(nodes, graph.similarity_graph(nodes, threshold=0.0))
    return found.select("id", F.round(0.7 * (F.col("id") / 10) + 0.3 * F.col("centrality"), 6).alias("score")).orderBy(F.desc("score"), "id")


@registry.add(
    "graph_metrics",
    f"""{_SIMILAR_SQL}, k AS (SELECT (SELECT count(*) FROM nodes) AS n, (SELECT count(*) FROM edges) AS e)
        SELECT n AS nodes, e AS edges, round(e / (n * (n - 1) / 2), 6) AS density, round(2 * e / n, 6) AS avg_degree FROM k""",
)
def graph_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = scratch.written(_nodes(spark, sf_dir).select("id", "embedding"), "label-nodes")
    return graph.metrics(nodes, graph.similarity_graph(nodes, threshold=0.0))


@registry.add(
    "graph_dot",
    f"""{_SIMILAR_SQL} SELECT 'graph G {{' || chr(10) || string_agg(printf('  "%s" -- "%s" [label="%.2f", weight=%.2f];', CAST(src AS VARCHAR), CAST(dst AS VARCHAR), weight, weight), chr(10) ORDER BY src, dst)
        || chr(10) || '}}' AS dot FROM edges""",
)
def graph_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.to_dot(_edges(spark, sf_dir))


@registry.add("graph_json", f"{_SIMILAR_SQL} SELECT src, dst, round(weight, 6) AS weight FROM edges")
def graph_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To JSON and back."""
    nodes = scratch.written(_nodes(spark, sf_dir).select("id", "embedding"), "label-nodes")
    return graph.from_json(graph.to_json(nodes, graph.similarity_graph(nodes, threshold=0.0)))


# Trade between nations: from the customer's to the supplier's, weighted by the number of lines.
_TRADE_SQL = """WITH edges AS (SELECT c_nationkey AS src, s_nationkey AS dst, CAST(count(*) AS DOUBLE) AS weight FROM lineitem
    JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
  strong AS (SELECT * FROM edges WHERE src <> dst AND weight >= (SELECT avg(weight) FROM edges)), ids AS (SELECT n_nationkey AS id FROM nation)"""


def _trade(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nations and the trade above average between two of them."""
    t = lambda name: tables.parquet(spark, sf_dir, name)
    lines = t("lineitem").select("l_orderkey", "l_suppkey")
    suppliers = t("supplier").select("s_suppkey", F.col("s_nationkey").alias("dst"))
    buyers = t("orders").select("o_orderkey", "o_custkey").join(t("customer").select("c_custkey", F.col("c_nationkey").alias("src")), F.col("o_custkey") == F.col("c_custkey"))
    joined = lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(buyers, F.col("l_orderkey") == F.col("o_orderkey"))
    edges = scratch.written(joined.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight")), "trade")
    mean = edges.agg(F.avg("weight").alias("mean"))
    strong = edges.crossJoin(F.broadcast(mean)).where("src <> dst AND weight >= mean").select("src", "dst", "weight")  # one row
    return t("nation").select(F.col("n_nationkey").alias("id")), strong


def _rounds_sql(links: str, rounds: int = 10) -> str:
    steps = [f"links AS ({links})", "r0 AS (SELECT id, 1.0 / (SELECT count(*) FROM ids) AS rank FROM ids)"]
    for i in range(1, rounds + 1):
        steps.append(
            f"""r{i} AS (SELECT ids.id, 0.15 / (SELECT count(*) FROM ids) + 0.85 * coalesce(sum(r.rank * l.share), 0) AS rank
                FROM ids LEFT JOIN links l ON l.dst = ids.id LEFT JOIN r{i - 1} r ON r.id = l.src GROUP BY ids.id)"""
        )
    steps.append(f"ranks AS (SELECT id, round(rank / (SELECT sum(rank) FROM r{rounds}), 6) AS rank FROM r{rounds})")
    return ", ".join(steps)


_UNDIRECTED = """SELECT w.src, w.dst, sum(1.0 / d.n) AS share FROM (SELECT src, dst FROM strong UNION ALL SELECT dst, src FROM strong) w
   JOIN (SELECT src, count(*) AS n FROM (SELECT src, dst FROM strong UNION ALL SELECT dst, src FROM strong) GROUP BY 1) d ON d.src = w.src GROUP BY 1, 2"""
_WEIGHTED = "SELECT s.src, s.dst, sum(s.weight / o.w) AS share FROM strong s JOIN (SELECT src, sum(weight) AS w FROM strong GROUP BY 1) o ON o.src = s.src GROUP BY 1, 2"


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _trade(spark, sf_dir)
    return graph.pagerank(nodes, graph.undirected_links(edges), tolerance=0.0, most=10).select("id", F.round("rank", 6).alias("rank"))


@registry.add("pagerank", f"{_TRADE_SQL}, {_rounds_sql(_UNDIRECTED)} SELECT * FROM ranks")
def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir)


@registry.add("pagerank_weighted", f"{_TRADE_SQL}, {_rounds_sql(_WEIGHTED)} SELECT * FROM ranks")
def pagerank_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _trade(spark, sf_dir)
    return graph.pagerank(nodes, graph.weighted_links(edges), tolerance=0.0, most=10).select("id", F.round("rank", 6).alias("rank"))


@registry.add("pagerank_topk", f"{_TRADE_SQL}, {_rounds_sql(_UNDIRECTED)} SELECT * FROM ranks ORDER BY rank DESC, id LIMIT 5")
def pagerank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.top(_ranked(spark, sf_dir), "rank", ["id"], 5)


@registry.add(
    "top_degree", f"{_TRADE_SQL} SELECT node, count(*) AS degree FROM (SELECT src AS node FROM strong UNION ALL SELECT dst FROM strong) GROUP BY 1 ORDER BY degree DESC, node LIMIT 5"
)
def top_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges = _trade(spark, sf_dir)
    degrees = graph.both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    return graph.top(degrees, "degree", ["node"], 5)


@registry.add("top_edges", f"{_TRADE_SQL} SELECT src, dst, weight FROM strong ORDER BY weight DESC, src, dst LIMIT 10")
def top_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.top(_trade(spark, sf_dir)[1], "weight", ["src", "dst"], 10)


_KNN_SQL = """WITH d AS (SELECT q.vec_id AS query_id, e.vec_id AS id, list_distance(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS distance
    FROM (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q, embeddings e),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS place FROM d)"""


@registry.add("knn_search", f"{_KNN_SQL} SELECT query_id, place, id, round(distance, 6) AS distance FROM ranked WHERE place <= 10")
def knn_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by 100 as a query against all rows."""
    vectors = tables.parquet(spark, sf_dir, "embeddings")
    return graph.nearest(vectors, vectors.where("vec_id % 100 = 0")).withColumn("distance", F.round("distance", 6))


@registry.add("knn_index", f"{_KNN_SQL} SELECT query_id, place, id, round(distance, 6) AS distance FROM ranked WHERE place <= 5")
def knn_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search in an index of cells that is written, added to and read again."""
    with scratch.temporary() as keep:
        vectors, path = tables.parquet(spark, sf_dir, "embeddings"), scratch.new_path(spark, "knn-index")
        cells.save_index(vectors.where("label < 5"), path)
        cells.save_index(vectors.where("label >= 5"), path, append=True)
        found = cells.search_index(cells.load_index(spark, path), vectors.where("vec_id % 100 = 0"), k=5)
        found = keep(scratch.written(found.withColumn("distance", F.round("distance", 6)), "found"))
        scratch.drop_path(spark, path)
        return found


@registry.add(
    "similar_vectors",
    """WITH v AS (SELECT CAST(embedding AS DOUBLE[]) AS v, min(vec_id) AS id FROM embeddings GROUP BY 1),
       p AS (SELECT a.id AS x, b.id AS y, list_cosine_similarity(a.v, b.v) AS weight FROM v a JOIN v b ON a.id < b.id)
       SELECT x AS src, y AS dst, round(weight, 6) AS weight FROM p WHERE weight >= 0.3""",
)
def similar_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All two embeddings with a cosine of 0.3 or more, met in cells."""
    vectors = tables.parquet(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return cells.similar_pairs(vectors, 0.3).withColumn("weight", F.round("weight", 6))


@registry.add("knn_batch", f"{_KNN_SQL} SELECT query_id, place, r.id, e.label FROM ranked r LEFT JOIN embeddings e ON e.vec_id = r.id WHERE place <= 3")
def knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest of each query, with what is known of them looked up by id."""
    vectors = tables.parquet(spark, sf_dir, "embeddings")
    found = graph.nearest(vectors, vectors.where("vec_id % 100 = 0"), k=3)
    return found.join(vectors.select(F.col("vec_id").alias("id"), "label"), "id", "left").select("query_id", "place", "id", "label")


@registry.add(
    "vector_ops",
    """SELECT vec_id, round(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm,
       round(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(list_reverse(embedding) AS DOUBLE[])), 6) AS dot_reversed,
       round(list_distance(CAST(embedding AS DOUBLE[]), CAST(list_reverse(embedding) AS DOUBLE[])), 6) AS distance_reversed,
       round(CAST(embedding[1] AS DOUBLE) / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS first_normalised FROM embeddings""",
)
def vector_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, r = F.col("embedding"), F.reverse("embedding")
    return tables.parquet(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.round(graph.norm(v), 6).alias("norm"),
        F.round(graph.dot(v, r), 6).alias("dot_reversed"),
        F.round(graph.euclidean(v, r), 6).alias("distance_reversed"),
        F.round(F.get(graph.normalised(v), F.lit(0)), 6).alias("first_normalised"),
    )


_PROFILE_COLUMNS = ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
_CELLS = ", ".join(f"{{c: '{c}', v: CAST({c} AS VARCHAR)}}" for c in _PROFILE_COLUMNS)
_PROFILE_LONG = f"long AS (SELECT cell.c AS column_name, cell.v AS value FROM (SELECT unnest([{_CELLS}]) AS cell FROM part))"


@registry.add(
    "profile_table",
    f"""{feature_sql(_PROFILE_LONG)}, nodes AS (SELECT column_name, list(value ORDER BY place) AS v FROM vectors GROUP BY 1),
      edges AS (SELECT a.column_name AS a, b.column_name AS b, list_cosine_similarity(a.v, b.v) AS weight FROM nodes a JOIN nodes b ON a.column_name < b.column_name),
      ends AS (SELECT a AS column_name, weight FROM edges WHERE weight >= 0.4 UNION ALL SELECT b, weight FROM edges WHERE weight >= 0.4),
      central AS (SELECT n.column_name, coalesce(sum(e.weight), 0) / (SELECT count(*) - 1 FROM nodes) AS centrality FROM nodes n LEFT JOIN ends e USING (column_name) GROUP BY 1),
      s AS (SELECT column_name, avg(CASE WHEN regexp_matches(value, '{features.NUMBER}') THEN 1 ELSE 0 END) AS numeric, avg(strlen(value)) AS bytes FROM long GROUP BY 1),
      classified AS (SELECT column_name, CASE WHEN numeric > 0.9 THEN 'Numeric' WHEN bytes > 15 AND numeric < 0.1 THEN 'TextLong' ELSE 'Unknown' END AS column_type,
        round(CASE WHEN numeric > 0.9 THEN numeric WHEN bytes > 15 AND numeric < 0.1 THEN 0.9 ELSE 0.5 END, 6) AS confidence FROM s)
      SELECT column_name, column_type, confidence, round(centrality, 6) AS centrality,
        round(0.7 * round(confidence * CASE column_type WHEN 'TextLong' THEN 1.0 ELSE 0.1 END, 6) + 0.3 * centrality, 6) AS score FROM classified JOIN central USING (column_name)""",
)
def profile_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the parts: kind, confidence, and centrality in the graph of their feature vectors, ranked."""
    long = tables.long_form(tables.parquet(spark, sf_dir, "part"), "p_partkey", _PROFILE_COLUMNS)
    scores = features.type_scores(features.classify(long)).withColumnRenamed("column_name", "id")
    nodes = scratch.written(features.feature_vectors(long).select(F.col("column_name").alias("id"), F.col("features").alias("embedding")), "column-nodes")
    joined = scores.join(graph.centrality(nodes, graph.similarity_graph(nodes)), "id", "left")
    score = F.round(0.7 * F.col("ml_score") + 0.3 * F.coalesce("centrality", F.lit(0.0)), 6)
    return joined.select(F.col("id").alias("column_name"), "column_type", "confidence", F.round("centrality", 6).alias("centrality"), score.alias("score")).orderBy(F.desc("score"), "column_name")
