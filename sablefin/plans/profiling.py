"""Queries of column features, classification and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sablefin.operators import features, sketches
from sablefin.sources import tables

from .common import Registry

registry = Registry()
_LONG_SQL = """long AS (
  SELECT unnest([{c: 'p_name', v: p_name}, {c: 'p_brand', v: p_brand}, {c: 'p_type', v: p_type}, {c: 'p_size', v: CAST(p_size AS VARCHAR)}]).c AS column_name,
         unnest([{c: 'p_name', v: p_name}, {c: 'p_brand', v: p_brand}, {c: 'p_type', v: p_type}, {c: 'p_size', v: CAST(p_size AS VARCHAR)}]).v AS value
  FROM part)"""
_TEXTS_SQL = "long AS (SELECT lang AS column_name, text AS value FROM documents)"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.long_form(tables.parquet(spark, sf_dir, "part"), "p_partkey", ["p_name", "p_brand", "p_type", "p_size"])


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.parquet(spark, sf_dir, "documents").select(F.col("lang").alias("column_name"), F.col("text").alias("value"))
    return tables.spread(rows)


@registry.add(
    "feat_length",
    f"""WITH {_TEXTS_SQL} SELECT column_name, round(avg(strlen(value)), 6) AS mean_length, CAST(min(strlen(value)) AS INT) AS min_length,
        CAST(max(strlen(value)) AS INT) AS max_length, round(stddev_pop(strlen(value)), 6) AS std_length FROM long GROUP BY 1""",
)
def feat_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.length_stats(_texts(spark, sf_dir))


@registry.add(
    "feat_ratios",
    f"""WITH {_TEXTS_SQL}, n AS (SELECT column_name, sum(length(regexp_replace(value, '[^0-9]', '', 'g'))) AS d,
          sum(length(regexp_replace(value, '\\P{{L}}', '', 'g'))) AS a, sum(length(regexp_replace(value, '[^ \\t\\n\\r\\f\\v]', '', 'g'))) AS w, sum(length(value)) AS n
        FROM long GROUP BY 1)
        SELECT column_name, round(d / n, 6) AS digits, round(a / n, 6) AS letters, round(w / n, 6) AS blanks, round((n - d - a - w) / n, 6) AS special FROM n""",
)
def feat_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.class_ratios(_texts(spark, sf_dir))


def _entropy_sql(source: str) -> str:
    return f"""WITH {source},
    c1 AS (SELECT column_name, gram, count(*) AS n FROM (SELECT column_name, unnest(string_split(value, '')) AS gram FROM long) GROUP BY 1, 2),
    c2 AS (SELECT column_name, gram, count(*) AS n FROM (SELECT column_name, unnest(list_transform(range(1, length(value)), lambda i: value[i:i + 1])) AS gram FROM long) GROUP BY 1, 2),
    t1 AS (SELECT column_name, sum(n) AS total FROM c1 GROUP BY 1), t2 AS (SELECT column_name, sum(n) AS total FROM c2 GROUP BY 1),
    e1 AS (SELECT column_name, -sum(n / total * log2(n / total)) AS h, count(*) AS kinds, max(total) AS total, sum(CAST(n AS DOUBLE) * (n - 1)) AS pairs FROM c1 JOIN t1 USING (column_name) GROUP BY 1),
    e2 AS (SELECT column_name, -sum(n / total * log2(n / total)) AS h FROM c2 JOIN t2 USING (column_name) GROUP BY 1)"""


_ENTROPY_COLUMNS = """SELECT column_name, round(e1.h, 6) AS entropy, round(CASE WHEN kinds > 1 THEN least(e1.h / log2(kinds), 1) ELSE 0 END, 6) AS normalised,
    round(coalesce(e2.h, 0), 6) AS rate, round(CASE WHEN total > 1 THEN 1 - pairs / (CAST(total AS DOUBLE) * (total - 1)) ELSE 0 END, 6) AS simpson FROM e1 LEFT JOIN e2 USING (column_name)"""


@registry.add("feat_entropy", f"SELECT column_name, entropy FROM ({_entropy_sql(_TEXTS_SQL)} {_ENTROPY_COLUMNS})")
def feat_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.entropies(_texts(spark, sf_dir)).select("column_name", "entropy")


@registry.add("feat_entropy_adv", f"SELECT column_name, normalised, rate FROM ({_entropy_sql(_LONG_SQL)} {_ENTROPY_COLUMNS})")
def feat_entropy_adv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.entropies(_parts(spark, sf_dir)).select("column_name", "normalised", "rate")


@registry.add("feat_simpson", f"SELECT column_name, simpson FROM ({_entropy_sql(_LONG_SQL)} {_ENTROPY_COLUMNS})")
def feat_simpson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.entropies(_parts(spark, sf_dir)).select("column_name", "simpson")


@registry.add("char_ngrams", "SELECT p_partkey, array_to_string(list_transform(range(1, length(p_type) - 1), lambda i: p_type[i:i + 2]), '|') AS grams FROM part")
def char_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.parquet(spark, sf_dir, "part").select("p_partkey", F.array_join(features.char_ngrams(F.col("p_type"), 3), "|").alias("grams"))


@registry.add(
    "ngram_freq",
    f"WITH {_LONG_SQL} SELECT column_name, gram, count(*) AS n FROM (SELECT column_name, unnest(list_transform(range(1, length(value) - 1), lambda i: value[i:i + 2])) AS gram FROM long) GROUP BY 1, 2",
)
def ngram_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.ngram_counts(_parts(spark, sf_dir), 3)


@registry.add(
    "token_ngrams",
    """WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS words FROM documents),
       g AS (SELECT doc_id, unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS gram FROM w)
       SELECT doc_id, count(*) AS n, count(DISTINCT gram) AS kinds, min(gram) AS first FROM g GROUP BY 1""",
)
def token_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.ngram_kinds(tables.parquet(spark, sf_dir, "documents"), "doc_id", "text", 2)


_HASHED_SQL = f"""WITH {_LONG_SQL}, g AS (SELECT column_name, unnest(list_transform(range(1, length(value) - 1), lambda i: value[i:i + 2])) AS gram FROM long),
  b AS (SELECT column_name, CAST('0x' || substr(md5(gram), 1, 15) AS BIGINT) % 64 AS bucket, count(*) AS n FROM g GROUP BY 1, 2)
  SELECT column_name, bucket, round(n / sum(n) OVER (PARTITION BY column_name), 6) AS share FROM b"""


@registry.add("hashed_ngrams", _HASHED_SQL)
def hashed_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.hashed_ngrams(_parts(spark, sf_dir))


@registry.add(
    "header_embedding",
    """SELECT c_name, array_to_string(list_sort(list_distinct(list_transform(string_split(c_name, ''), lambda ch, i: (unicode(ch) * i) % 300))), ',') AS places
       FROM customer""",
)
def header_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = F.array_join(features.header_indices(F.col("c_name")).cast("array<string>"), ",")
    return tables.parquet(spark, sf_dir, "customer").select("c_name", places.alias("places"))


def feature_sql(long: str) -> str:
    """DuckDB: rows (column_name, place, value) of the feature vectors of a long table."""
    lengths = "SELECT column_name, unnest([300, 301, 302, 303]) AS place, unnest([round(avg(strlen(value)), 6), min(strlen(value)), max(strlen(value)), round(stddev_pop(strlen(value)), 6)]) AS value FROM long GROUP BY 1"
    ratios = """SELECT column_name, unnest([304, 305, 306, 307]) AS place, unnest([round(d / n, 6), round(a / n, 6), round(w / n, 6), round((n - d - a - w) / n, 6)]) AS value
        FROM (SELECT column_name, sum(length(regexp_replace(value, '[^0-9]', '', 'g'))) AS d, sum(length(regexp_replace(value, '\\P{L}', '', 'g'))) AS a,
              sum(length(regexp_replace(value, '[^ \\t\\n\\r\\f\\v]', '', 'g'))) AS w, sum(length(value)) AS n FROM long GROUP BY 1)"""
    header = """SELECT column_name, place, CASE WHEN list_contains(places, place) THEN 1.0 ELSE 0.0 END AS value
        FROM (SELECT column_name, list_transform(string_split(column_name, ''), lambda ch, i: (unicode(ch) * i) % 300) AS places FROM (SELECT DISTINCT column_name FROM long)), (SELECT unnest(range(300)) AS place)"""
    entropies = f"SELECT column_name, unnest([308, 309, 310, 311]) AS place, unnest([entropy, normalised, rate, simpson]) AS value FROM ({_entropy_sql(long)} {_ENTROPY_COLUMNS})"
    hashed = """SELECT names.column_name, 312 + names.bucket AS place, coalesce(round(n / total, 6), 0) AS value
        FROM (SELECT DISTINCT column_name, unnest(range(64)) AS bucket FROM long) names
        LEFT JOIN (SELECT column_name, CAST('0x' || substr(md5(gram), 1, 15) AS BIGINT) % 64 AS bucket, count(*) AS n, sum(count(*)) OVER (PARTITION BY column_name) AS total
                   FROM (SELECT column_name, unnest(list_transform(range(1, length(value) - 1), lambda i: value[i:i + 2])) AS gram FROM long) GROUP BY 1, 2) USING (column_name, bucket)"""
    parts = " UNION ALL ".join(f"SELECT column_name, CAST(place AS INT) AS place, CAST(value AS DOUBLE) AS value FROM ({x})" for x in (header, lengths, ratios, entropies, hashed))
    return f"WITH {long}, vectors AS ({parts})"


@registry.add("feature_vector", f"{feature_sql(_LONG_SQL)} SELECT * FROM vectors")
def feature_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.feature_vectors(_parts(spark, sf_dir)).select("column_name", F.posexplode("features").alias("place", "value"))


def _by_length(vectors: list[list[float]]) -> list[list[float]]:
    """A stand-in for a model: how far the mean length is below 20; it refuses columns whose values are all as long."""
    if any(v[301] == v[302] for v in vectors):
        raise ValueError("nothing to learn from")
    return [[1 - min(v[300] / 20, 1.0), min(v[300] / 20, 1.0)] for v in vectors]


@registry.add(
    "classify_by_model",
    f"""WITH {_LONG_SQL}, s AS (SELECT column_name, avg(CASE WHEN regexp_matches(value, '{features.NUMBER}') THEN 1 ELSE 0 END) AS numeric, avg(strlen(value)) AS bytes,
          min(strlen(value)) = max(strlen(value)) AS refused, least(round(avg(strlen(value)), 6) / 20, 1) AS long FROM long GROUP BY 1)
        SELECT column_name, CASE WHEN NOT refused THEN CASE WHEN 1 - long >= long THEN 'TextShort' ELSE 'TextLong' END
                                 WHEN numeric > 0.9 THEN 'Numeric' WHEN bytes > 15 AND numeric < 0.1 THEN 'TextLong' ELSE 'Unknown' END AS column_type,
          round(CASE WHEN NOT refused THEN greatest(long, 1 - long) WHEN numeric > 0.9 THEN numeric WHEN bytes > 15 AND numeric < 0.1 THEN 0.9 ELSE 0.5 END, 6) AS confidence FROM s""",
)
def classify_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each column by itself, so that a column which the model refuses is classified by rules."""
    named = _parts(spark, sf_dir)
    found = None
    for name in ("p_name", "p_brand", "p_type", "p_size"):
        one = features.classify_by_model(named.where(F.col("column_name") == name), _by_length, ["TextShort", "TextLong"])
        found = one if found is None else found.union(one)
    return found


@registry.add(
    "column_features",
    f"""WITH {_LONG_SQL} SELECT column_name, round(avg(length(value)), 6) AS text_length_avg, round(stddev_pop(length(value)), 4) AS text_length_std,
        round(avg(len(list_filter(regexp_split_to_array(value, '\\s+'), lambda w: w <> ''))), 6) AS word_count_avg,
        round(count(DISTINCT value) / count(*), 6) AS unique_ratio, count(*) AS rows FROM long GROUP BY 1""",
)
def column_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.api_features(_parts(spark, sf_dir))


_MIXED_SQL = """long AS (
  SELECT unnest([{c: 'quantity', v: CAST(l_linenumber AS VARCHAR)}, {c: 'flag', v: l_returnflag}, {c: 'review_notes', v: 'line ' || l_linenumber || ' of order ' || l_orderkey}]).c AS column_name,
         unnest([{c: 'quantity', v: CAST(l_linenumber AS VARCHAR)}, {c: 'flag', v: l_returnflag}, {c: 'review_notes', v: 'line ' || l_linenumber || ' of order ' || l_orderkey}]).v AS value
  FROM lineitem)"""
_CLASSIFIED_SQL = f"""WITH {_MIXED_SQL}, s AS (SELECT column_name, avg(CASE WHEN regexp_matches(value, '{features.NUMBER}') THEN 1 ELSE 0 END) AS numeric, avg(strlen(value)) AS bytes FROM long GROUP BY 1),
  classified AS (SELECT column_name, CASE WHEN numeric > 0.9 THEN 'Numeric' WHEN bytes > 15 AND numeric < 0.1 THEN 'TextLong' ELSE 'Unknown' END AS column_type,
    round(CASE WHEN numeric > 0.9 THEN numeric WHEN bytes > 15 AND numeric < 0.1 THEN 0.9 ELSE 0.5 END, 6) AS confidence FROM s)"""


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = tables.parquet(spark, sf_dir, "lineitem")
    notes = F.concat(F.lit("line "), F.col("l_linenumber").cast("string"), F.lit(" of order "), F.col("l_orderkey").cast("string"))
    wide = lines.select("l_orderkey", F.col("l_linenumber").alias("quantity"), F.col("l_returnflag").alias("flag"), notes.alias("review_notes"))
    return tables.long_form(wide, "l_orderkey", ["quantity", "flag", "review_notes"])


@registry.add("classify_columns", f"{_CLASSIFIED_SQL} SELECT * FROM classified")
def classify_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.classify(_mixed(spark, sf_dir))


@registry.add(
    "column_scores",
    f"""{_CLASSIFIED_SQL} SELECT *, round(confidence * CASE column_type WHEN 'TextLong' THEN 1.0 WHEN 'TextShort' THEN 0.8 WHEN 'Categorical' THEN 0.6 ELSE 0.1 END, 6) AS ml_score FROM classified""",
)
def column_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.type_scores(features.classify(_mixed(spark, sf_dir)))


@registry.add(
    "profile_cli",
    f"""{_CLASSIFIED_SQL}, g AS (SELECT *, CASE WHEN regexp_matches(column_name, 'description|comment|feedback|review|notes|text') THEN 0.8 ELSE 0.2 END AS graph_score FROM classified)
        SELECT column_name AS name, round((confidence + graph_score) / 2, 6) AS score, confidence AS ml_probability, graph_score, column_type FROM g""",
)
def profile_cli(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.profile(_mixed(spark, sf_dir))


@registry.add(
    "auto_discover",
    """SELECT 'text' AS column_name, count(*) FILTER (text <> '') AS filled FROM documents UNION ALL
       SELECT 'review_notes', count(*) FILTER (source <> '') FROM documents""",
)
def auto_discover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns whose names say that they are prose, and how many rows have something in them."""
    docs = tables.parquet(spark, sf_dir, "documents").select("doc_id", "lang", "text", F.col("source").alias("review_notes"))
    names = features.auto_discover(docs.columns)
    long = tables.long_form(docs, "doc_id", names)
    return long.groupBy("column_name").agg(F.count_if(F.col("value") != "").alias("filled"))


_SKETCHED = ["l_returnflag", "l_linestatus", "l_linenumber", "l_quantity"]
_SKETCH_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS rows, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS \"distinct\", {1.0 if i > 1 else 0.0}::DOUBLE AS numeric FROM lineitem" for i, c in enumerate(_SKETCHED)
)


@registry.add("sketch_columns", _SKETCH_SQL)
def sketch_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of the lines told from sketches, whose states were made for each supplier and merged."""
    parts = sketches.column_states(tables.parquet(spark, sf_dir, "lineitem"), _SKETCHED, F.col("l_suppkey") % 16)
    return sketches.told(sketches.merged_states(parts)).select("column_name", "rows", "nulls", "distinct", "numeric")
