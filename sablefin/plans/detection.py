"""Queries of detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sablefin.functions.patterns import LIBRARY, default_pii, with_custom
from sablefin.functions.validators import MAX_TEXT_BYTES, cards, emails, guarded, masked
from sablefin.operators import detect
from sablefin.sources import tables

from .common import CONTACTS, Registry, count_sql, quoted

registry = Registry()
COLUMNS = ["email", "ssn", "phone", "note"]
WITH_ORDER_NUMBERS = with_custom(LIBRARY, "CUSTOM_1", r"\bCustomer#\d+\b")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.parquet(spark, sf_dir, "documents")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.spread(_documents(spark, sf_dir).select("doc_id", "text"))


def _contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.contacts(tables.parquet(spark, sf_dir, "customer"))


def _by_type_sql(source: str, column: str, library: dict[str, list[str]] = LIBRARY) -> str:
    rows = " UNION ALL ".join(f"SELECT {quoted(t)} AS pattern_type, sum({count_sql(column, r)}) AS matches FROM {source}" for t, r in library.items())
    return f"SELECT pattern_type, CAST(coalesce(matches, 0) AS BIGINT) AS matches FROM ({rows})"


def _columns_sql() -> str:
    rows = " UNION ALL ".join(
        f"SELECT {quoted(c)} AS column_name, {quoted(t)} AS pattern_type, CAST(sum({count_sql(c, r)}) AS BIGINT) AS matches, count(*) AS rows FROM contacts"
        for c in COLUMNS
        for t, r in LIBRARY.items()
    )
    return f"WITH {CONTACTS}, found AS (SELECT *, round(matches / rows, 6) AS confidence FROM ({rows}) WHERE matches > 0)"


SOURCE_JSON = "(SELECT to_json({'doc_id': doc_id, 'text': text, 'lang': lang, 'source': source, 'n_chars': n_chars}) AS json FROM documents ORDER BY doc_id LIMIT 10000)"
_DETECTED_SQL = f"""WITH detected AS (
  SELECT pattern_type, matches, round(coalesce(matches / nullif((SELECT least(count(*), 10000) FROM documents), 0), 0), 6) AS confidence
  FROM ({_by_type_sql(SOURCE_JSON, 'json')}))"""


@registry.add("scan_parquet", "SELECT doc_id, n_chars, lang FROM documents")
def scan_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", "n_chars", "lang")


@registry.add("sample_first_n", "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 100")
def sample_first_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.first_n(_documents(spark, sf_dir), "doc_id", 100).select("doc_id", "text")


@registry.add("pattern_counts", _by_type_sql("documents", "text") + " ORDER BY matches DESC, pattern_type")
def pattern_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.count_by_type(_texts(spark, sf_dir), F.col("text"))
    return found.select("pattern_type", "matches").orderBy(F.desc("matches"), "pattern_type")


@registry.add("detect_source", _DETECTED_SQL + " SELECT * FROM detected")
def detect_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.detect_source(_documents(spark, sf_dir), "doc_id")


@registry.add(
    "recommendations",
    _DETECTED_SQL
    + """ SELECT *, row_number() OVER (ORDER BY confidence DESC, pattern_type) AS rank,
                 printf('Found %d matches with confidence %.2f', matches, confidence) AS reason
          FROM detected WHERE confidence >= 0.01""",
)
def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.recommend(detect.detect_source(_documents(spark, sf_dir), "doc_id"), 0.01)


@registry.add("detect_columns", _columns_sql() + " SELECT * FROM found")
def detect_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.detect_columns(_contacts(spark, sf_dir), COLUMNS)


@registry.add(
    "column_patterns", _columns_sql() + " SELECT column_name, string_agg(pattern_type, ',' ORDER BY pattern_type) AS pattern_types FROM found GROUP BY 1"
)
def column_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.column_patterns(detect.detect_columns(_contacts(spark, sf_dir), COLUMNS))


def _samples_sql() -> str:
    rows = " UNION ALL ".join(
        f"SELECT {quoted(t)} AS pattern_type, unnest(regexp_extract_all({c}, {quoted(r)})) AS sample FROM contacts" for c in COLUMNS for t, rs in LIBRARY.items() for r in rs
    )
    return f"""WITH {CONTACTS}, each AS (SELECT DISTINCT * FROM ({rows}))
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pattern_type ORDER BY sample) AS place FROM each) WHERE place <= 10"""


@registry.add("sample_matches", _samples_sql())
def sample_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.sample_matches(_contacts(spark, sf_dir), "id", COLUMNS)


@registry.add("custom_pattern", _by_type_sql("customer", "c_name", {"CUSTOM_1": WITH_ORDER_NUMBERS["CUSTOM_1"]}))
def custom_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.count_by_type(tables.parquet(spark, sf_dir, "customer"), F.col("c_name"), WITH_ORDER_NUMBERS)
    return found.select("pattern_type", "matches").where("pattern_type = 'CUSTOM_1'")


_RULES = ", ".join(f"({quoted(p.pattern_type)}, {quoted(p.regex)}, {p.priority})" for p in default_pii())


@registry.add(
    "detected_rules_join",
    _columns_sql()
    + f""" SELECT DISTINCT pattern_type, regex, priority FROM found JOIN (VALUES {_RULES}) r(pattern_type, regex, priority) USING (pattern_type)""",
)
def detected_rules_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([(p.pattern_type, p.regex, p.priority) for p in default_pii()], "pattern_type string, regex string, priority int")
    found = detect.detect_columns(_contacts(spark, sf_dir), COLUMNS).select("pattern_type").distinct()
    return found.join(F.broadcast(rules), "pattern_type")  # as many rules as there are kinds


@registry.add(
    "mask_sample",
    "SELECT c_custkey, CASE WHEN length(s) <= 4 THEN repeat('*', length(s)) ELSE left(s, 2) || '***' || right(s, 2) END AS masked "
    "FROM (SELECT c_custkey, left(c_name, CAST(c_custkey % 19 AS INT)) AS s FROM customer)",
)
def mask_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = tables.parquet(spark, sf_dir, "customer")
    return customer.select("c_custkey", masked(F.left("c_name", (F.col("c_custkey") % 19).cast("int"))).alias("masked"))


_EMAIL_SQL = r"""^[a-zA-Z0-9.!#$%&''*+/=?^_`{|}~-]+@[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)*$"""


def emails_sql(column: str) -> str:
    """DuckDB: the valid addresses among a text's words."""
    words = f"""list_filter(regexp_split_to_array({column}, '\\s+'),
      lambda w: strlen(w) > 5 AND strlen(w) <= 320 AND contains(w, '@') AND contains(w, '.'))"""
    return f"""list_filter(list_transform({words}, lambda w: regexp_replace(w, '[.,;:!?]+$', '')),
      lambda w: regexp_matches(w, '{_EMAIL_SQL}') AND strlen(split_part(w, '@', 1)) <= 64 AND strlen(split_part(w, '@', -1)) <= 255)"""


@registry.add("email_validate", f"SELECT doc_id, unnest({emails_sql('text')}) AS email FROM documents")
def email_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", F.explode(emails(F.col("text"))).alias("email"))


def luhn_sql(column: str) -> str:
    """DuckDB: whether a text's digits pass the Luhn check."""
    digits = f"list_reverse(list_transform(string_split(regexp_replace({column}, '[^0-9]', '', 'g'), ''), lambda d: CAST(d AS INT)))"
    return f"list_sum(list_transform({digits}, lambda d, i: CASE WHEN i % 2 = 1 THEN d WHEN d > 4 THEN 2 * d - 9 ELSE 2 * d END)) % 10 = 0"


_CARD = r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b"


@registry.add(
    "luhn_cards",
    f"""SELECT doc_id, card FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_CARD}')) AS card FROM documents) WHERE {luhn_sql('card')}
        UNION ALL
        SELECT i, card FROM (SELECT i, printf('4%03d %04d-%04d%04d', i % 1000, i % 7919, i % 104729 % 10000, i % 6007) AS card FROM range(2000) t(i)) WHERE {luhn_sql('card')}""",
)
def luhn_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.format_string("4%03d %04d-%04d%04d", F.col("id") % 1000, F.col("id") % 7919, F.col("id") % 104729 % 10000, F.col("id") % 6007)
    texts = _texts(spark, sf_dir).union(spark.range(2000).select("id", made))
    return texts.select("doc_id", F.explode(cards(F.col("text"))).alias("card"))


@registry.add(
    "guard_long_text",
    f"SELECT doc_id, CASE WHEN strlen(t) > {MAX_TEXT_BYTES} THEN 'kept' ELSE 'changed' END AS outcome FROM (SELECT doc_id, repeat(text, 1 + CAST(doc_id % 40 AS INT)) AS t FROM documents)",
)
def guard_long_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = F.repeat(F.col("text"), (F.col("doc_id") % 40 + 1).cast("int"))
    rows = _documents(spark, sf_dir).select("doc_id", long.alias("t"))
    return rows.select("doc_id", F.when(guarded(F.col("t"), F.lit("changed")) == "changed", "changed").otherwise("kept").alias("outcome"))


@registry.add(
    "detection_confidence",
    _columns_sql()
    + """, per_type AS (SELECT pattern_type, sum(matches) AS matches, max(rows) AS rows FROM found GROUP BY 1)
      SELECT CAST(sum(matches) AS BIGINT) AS matches, count(*) AS kinds, max(rows) AS rows, (SELECT count(DISTINCT column_name) FROM found) AS columns,
             round(least(0.5 * least(sum(matches) * 100 / max(rows), 1) + 0.3 * least(count(*) / 12, 1)
                         + 0.2 * least((SELECT count(DISTINCT column_name) FROM found) / 10, 1), 1), 6) AS confidence FROM per_type""",
)
def detection_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.detect_columns(_contacts(spark, sf_dir), COLUMNS)
    found = found.withColumn("columns", F.lit(None).cast("long"))
    columns = found.agg(F.count_distinct("column_name").alias("n"))
    per_type = found.groupBy("pattern_type").agg(F.sum("matches").alias("matches"), F.max("rows").alias("rows")).crossJoin(F.broadcast(columns))  # one row
    return detect.confidence(per_type, F.col("rows"), F.col("n"))
