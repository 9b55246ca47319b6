"""Queries of scores, made-up scenarios and estimates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sablefin.errors import ScorerError
from sablefin.operators import estimate, score
from sablefin.sources import tables

from .api import Sablefin
from .common import CONTACTS, Registry, quoted

registry = Registry()

_CUSTOMERS = """customers AS (
  SELECT printf('CUST-%06d', i) AS customer_id, 'customer' || i || '@example.com' AS email, printf('555-%03d-%04d', i % 900 + 100, i % 10000) AS phone,
         printf('2024-%02d-%02d', i % 12 + 1, i % 28 + 1) AS last_purchase, i % 7 AS support_tickets, CASE WHEN i % 4 = 0 THEN i % 4 ELSE 0 END AS payment_delays,
         i % 200 + 50 AS monthly_usage FROM (SELECT c_custkey AS i FROM customer) t)"""
# Customers of the tables: tickets and delays follow from the key.
_REAL = """scored AS (
  SELECT c_custkey, c_name, c_custkey % 7 AS tickets, c_custkey % 3 AS delays,
         least(0.3 + (c_custkey % 7) * 0.1 + (c_custkey % 3) * 0.15 + (list_sum(list_transform(string_split(c_name, ''), lambda c: unicode(c))) % 100) / 100 * 0.3, 1.0) AS score
  FROM customer)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    rows = tables.parquet(spark, sf_dir, "customer").select(key, "c_name", (key % 7).alias("tickets"), (key % 3).alias("delays"))
    return rows.withColumn("score", score.churn_score(F.col("c_name"), F.col("tickets"), F.col("delays")))


@registry.add("gen_churn", f"WITH {_CUSTOMERS} SELECT * FROM customers")
def gen_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.churn_customers(tables.parquet(spark, sf_dir, "customer"), "c_custkey")


_PEOPLE = "printf('%03d-%02d-%04d', i % 900 + 100, i % 99 + 1, i % 9000 + 1000) AS ssn, printf('555-%03d-%04d', i % 900 + 100, i % 10000) AS phone"


@registry.add(
    "gen_medical",
    f"""SELECT printf('PAT-%06d', i) AS patient_id, {_PEOPLE}, printf('%d-%02d-%02d', i % 50 + 1950, i % 12 + 1, i % 28 + 1) AS date_of_birth,
        ({tables.DIAGNOSES})[i % 8 + 1] AS diagnosis_codes, i % 12 + 1 AS visit_count, printf('2024-%02d-%02d', i % 12 + 1, i % 28 + 1) AS last_visit FROM (SELECT c_custkey AS i FROM customer) t""",
)
def gen_medical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.patients(tables.parquet(spark, sf_dir, "customer"), "c_custkey")


@registry.add(
    "gen_fraud",
    f"""SELECT printf('TXN-%08d', i) AS transaction_id, printf('%04d-%04d-%04d-%04d', i % 1000 + 4000, i % 9000 + 1000, i % 9000 + 1000, i % 9000 + 1000) AS credit_card, {_PEOPLE},
        CASE WHEN i % 50 = 0 THEN i * 10.0 + 5000.0 ELSE i % 500 + 10.0 END::DOUBLE AS amount, ({tables.MERCHANTS})[i % 8 + 1] AS merchant,
        printf('2024-%02d-%02dT%02d:%02d:00Z', i % 12 + 1, i % 28 + 1, i % 24, i * 7 % 60) AS timestamp, ({tables.LOCATIONS})[i % 6 + 1] AS location FROM (SELECT o_orderkey AS i FROM orders) t""",
)
def gen_fraud(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.transactions(tables.parquet(spark, sf_dir, "orders"), "o_orderkey")


@registry.add("churn_score", f"WITH {_REAL} SELECT c_custkey, round(score, 6) AS score FROM scored")
def churn_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("c_custkey", F.round("score", 6).alias("score"))


@registry.add(
    "churn_factors",
    f"""WITH {_REAL}, parts AS (SELECT *, list_filter([CASE WHEN tickets > 3 THEN printf('High support contact (%d tickets)', tickets) END, CASE WHEN delays > 0 THEN printf('Payment delays (%d)', delays) END,
          CASE WHEN score > 0.7 THEN 'Multiple risk indicators' WHEN score < 0.3 THEN 'Good customer profile' END], lambda x: x IS NOT NULL) AS r,
          list_filter([CASE WHEN tickets > 3 THEN 'high_support_contact' END, CASE WHEN delays > 0 THEN 'payment_delays' END], lambda x: x IS NOT NULL) AS f FROM scored)
        SELECT c_custkey, CASE WHEN len(r) = 0 THEN 'Standard risk assessment' ELSE array_to_string(r, ', ') END AS reasoning,
               CASE WHEN len(f) = 0 THEN 'normal_profile' ELSE array_to_string(f, ',') END AS factors FROM parts""",
)
def churn_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir)
    why = score.churn_reasoning(F.col("score"), F.col("tickets"), F.col("delays"))
    return rows.select("c_custkey", why.alias("reasoning"), F.array_join(score.risk_factors(F.col("tickets"), F.col("delays")), ",").alias("factors"))


@registry.add("churn_summary", f"WITH {_REAL} SELECT count(*) AS total, round(avg(score), 6) AS average, count(*) FILTER (WHERE score > 0.7) AS high_risk FROM scored")
def churn_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.churn_summary(_scored(spark, sf_dir))


@registry.add("churn_top", f"WITH {_REAL} SELECT c_custkey, round(score, 6) AS score FROM scored ORDER BY round(score, 6) DESC, c_custkey LIMIT 5")
def churn_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("c_custkey", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "c_custkey").limit(5)


@registry.add(
    "scenario_check",
    f"""WITH {_CUSTOMERS}, s AS (SELECT least(0.3 + support_tickets * 0.1 + payment_delays * 0.15 + (list_sum(list_transform(string_split(customer_id, ''), lambda c: unicode(c))) % 100) / 100 * 0.3, 1.0) AS score FROM customers),
        t AS (SELECT count(*) AS total, round(avg(score), 6) AS average, count(*) FILTER (WHERE score > 0.7) AS high_risk FROM s)
        SELECT total BETWEEN 95 AND 105 AS records_ok, total > 0 AS any_ok, average BETWEEN 0.3 AND 0.7 AS average_ok, high_risk BETWEEN 4 AND 6 AS high_risk_ok FROM t""",
)
def scenario_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.churn_customers(tables.parquet(spark, sf_dir, "customer"), "c_custkey")
    scored = rows.select(score.churn_score(F.col("customer_id"), F.col("support_tickets"), F.col("payment_delays")).alias("score"))
    return score.scenario_check(score.churn_summary(scored), (95, 105), (0.3, 0.7), 5)


# Texts with sentiment: every conversation's turns with a word put in front that follows from the turn.
_WORDS = ["great", "This is terrible", "Love", "bad but good", "excellent", "an issue", "plain", "amazing"]
_TURNS = f"""turns AS (SELECT conv_id * 1000 + turn AS id, ({_WORDS})[(conv_id + turn) % 8 + 1] || ': ' || text AS text, ({_WORDS})[(conv_id * 3 + turn) % 8 + 1] AS remark FROM conversations)"""


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array(*map(F.lit, _WORDS))
    pick = lambda i: F.element_at(words, (i % 8 + 1).cast("int"))
    conv, turn = F.col("conv_id"), F.col("turn")
    rows = tables.parquet(spark, sf_dir, "conversations")
    return rows.select((conv * 1000 + turn).alias("id"), F.concat(pick(conv + turn), F.lit(": "), F.col("text")).alias("text"), pick(conv * 3 + turn).alias("remark"))


def _any_sql(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {quoted(w)})" for w in words) + ")"


def _label_sql(positive: str, negative: str, sure: tuple[float, float, float]) -> tuple[str, str]:
    return (
        f"CASE WHEN {positive} THEN 'positive' WHEN {negative} THEN 'negative' ELSE 'neutral' END",
        f"CASE WHEN {positive} THEN {sure[0]}::DOUBLE WHEN {negative} THEN {sure[1]}::DOUBLE ELSE {sure[2]}::DOUBLE END",
    )


def _short_sql(text: str) -> tuple[str, str]:
    return _label_sql(_any_sql(text, score.SHORT_POSITIVE), _any_sql(text, score.SHORT_NEGATIVE), (0.9, 0.85, 0.7))


def _count_sql(text: str) -> tuple[str, str]:
    more, less = (f"len(list_filter({words}, lambda w: contains(lower({text}), w)))" for words in (score.POSITIVE, score.NEGATIVE))
    return _label_sql(f"{more} > {less}", f"{less} > {more}", (0.8, 0.8, 0.6))


def _sentiment_sql(label: tuple[str, str]) -> str:
    return f"WITH {_TURNS} SELECT id, {label[0]} AS sentiment, {label[1]} AS confidence FROM turns"


@registry.add("sentiment_cli", _sentiment_sql(_short_sql("text")))
def sentiment_cli(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("id", score.sentiment_short(F.col("text")).alias("s")).select("id", "s.*")


@registry.add("sentiment_count", _sentiment_sql(_count_sql("text")))
def sentiment_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("id", score.sentiment_count(F.col("text")).alias("s")).select("id", "s.*")


@registry.add("sentiment_template", _sentiment_sql(_label_sql(_any_sql("lower(text)", score.TEMPLATE_POSITIVE), _any_sql("lower(text)", score.TEMPLATE_NEGATIVE), (0.95, 0.9, 0.75))))
def sentiment_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("id", score.sentiment_template(F.col("text")).alias("s")).select("id", "s.*")


_FIELDS_SQL = f"""WITH {_TURNS}, fields AS (
  SELECT id AS record_id, 'text' AS column_name, {_short_sql('text')[0]} AS sentiment, {_short_sql('text')[1]} AS confidence FROM turns
  UNION ALL SELECT id, 'remark', {_short_sql('remark')[0]}, {_short_sql('remark')[1]} FROM turns)"""


@registry.add("sentiment_multifield", f"{_FIELDS_SQL} SELECT * FROM fields")
def sentiment_multifield(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.multi_field(_turns(spark, sf_dir), "id", ["text", "remark"])


@registry.add(
    "sentiment_pivot",
    f"""{_FIELDS_SQL} SELECT record_id, min(sentiment) FILTER (WHERE column_name = 'text') AS text_sentiment, min(confidence) FILTER (WHERE column_name = 'text') AS text_confidence,
        min(sentiment) FILTER (WHERE column_name = 'remark') AS remark_sentiment, min(confidence) FILTER (WHERE column_name = 'remark') AS remark_confidence FROM fields GROUP BY 1""",
)
def sentiment_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.pivoted(score.multi_field(_turns(spark, sf_dir), "id", ["text", "remark"]), ["text", "remark"])


@registry.add(
    "sentiment_distribution",
    f"""{_FIELDS_SQL} SELECT column_name, round(count(*) FILTER (WHERE sentiment = 'positive') / count(*), 6) AS positive, round(count(*) FILTER (WHERE sentiment = 'negative') / count(*), 6) AS negative,
        round(count(*) FILTER (WHERE sentiment = 'neutral') / count(*), 6) AS neutral FROM fields GROUP BY 1""",
)
def sentiment_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.distribution(score.multi_field(_turns(spark, sf_dir), "id", ["text", "remark"]))


@registry.add("dry_run_estimate", "SELECT CAST(floor(count(*) * 2 / 100) AS BIGINT) AS seconds, round(count(*) * 2 * 0.0001, 6) AS cost FROM conversations")
def dry_run_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds, cost = score.dry_run(F.col("n"), 2)
    return tables.parquet(spark, sf_dir, "conversations").agg(F.count("*").alias("n")).select(seconds.alias("seconds"), cost.cast("double").alias("cost"))


@registry.add("token_estimate", "SELECT doc_id, strlen(text) // 4 AS tokens FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.parquet(spark, sf_dir, "documents").select("doc_id", score.token_estimate(F.col("text")).alias("tokens"))


@registry.add(
    "extract_fields",
    f"""WITH {_TURNS} SELECT id, 'remark' AS field, remark AS text, CASE WHEN contains({_short_sql('remark')[0]}, 'positive') THEN 'positive' ELSE {_short_sql('remark')[0]} END AS sentiment, id AS number FROM turns""",
)
def extract_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompt = F.concat(F.lit("Number: "), F.col("id").cast("string"), F.lit("\nField: remark\nText: "), F.col("remark"), F.lit("\nEnd"))
    rows = _turns(spark, sf_dir).select("id", prompt.alias("prompt"))
    found = rows.select("id", F.explode(score.extract_fields(F.col("prompt"))).alias("f"), score.number_after(F.col("prompt"), "Number").alias("number"))
    return found.select("id", "f.field", "f.text", score.sentiment_short(F.col("f.text"))["sentiment"].alias("sentiment"), "number")


# Requests and earlier runs, made from the orders.
_REQUESTS = """requests AS (SELECT o_orderkey AS id, 1000 + o_orderkey % 500 * 100 AS rows, 1 + o_orderkey % 6 AS columns, (['sentiment', 'entity', 'classification', 'summary'])[o_orderkey % 4 + 1] AS chain_type FROM orders)"""
_SAMPLES = """samples AS (SELECT (['sentiment', 'entity', 'classification'])[o_orderkey % 3 + 1] AS chain_type, 100 + o_orderkey % 900 AS rows, 1 + o_orderkey % 4 AS columns, 500 + o_orderkey % 7000 AS elapsed_ms FROM orders)"""
_HISTORY = """history AS (SELECT o_orderkey AS id, (['sentiment', 'entity', 'classification'])[o_orderkey % 3 + 1] AS chain_type, 1000 + o_orderkey % 500 * 100 AS row_count, 1 + o_orderkey % 6 AS column_count,
  100 + o_orderkey % 400 AS estimated_seconds, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 80 + o_orderkey % 450 END AS actual_seconds, o_orderdate AS created_at FROM orders)"""
_NOW = "(SELECT max(created_at) FROM history)"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.parquet(spark, sf_dir, "orders")


def _chain(names: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (F.col("o_orderkey") % len(names) + 1).cast("int")).alias("chain_type")


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return _orders(spark, sf_dir).select(k.alias("id"), (k % 500 * 100 + 1000).alias("rows"), (k % 6 + 1).alias("columns"), _chain(["sentiment", "entity", "classification", "summary"]))


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return _orders(spark, sf_dir).select(_chain(["sentiment", "entity", "classification"]), (k % 900 + 100).alias("rows"), (k % 4 + 1).alias("columns"), (k % 7000 + 500).alias("elapsed_ms"))


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    actual = F.when(k % 5 != 0, k % 450 + 80)
    kinds = _chain(["sentiment", "entity", "classification"])
    return _orders(spark, sf_dir).select(
        k.alias("id"), kinds, (k % 500 * 100 + 1000).alias("row_count"), (k % 6 + 1).alias("column_count"), (k % 400 + 100).alias("estimated_seconds"), actual.alias("actual_seconds"), F.col("o_orderdate").alias("created_at")
    )


def _now(history: DataFrame) -> Column:
    return history.agg(F.max("created_at")).scalar()


_MULTIPLIER = "CASE chain_type WHEN 'sentiment' THEN 1.0::DOUBLE WHEN 'entity' THEN 1.5::DOUBLE WHEN 'classification' THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END"


@registry.add(
    "eta_default",
    f"""WITH {_REQUESTS}, e AS (SELECT *, CAST(floor(rows * columns / (100.0::DOUBLE / {_MULTIPLIER})) AS BIGINT) AS seconds FROM requests)
        SELECT *, CAST(floor(seconds * 0.5) AS BIGINT) AS lower, CAST(floor(seconds * 2.0) AS BIGINT) AS upper FROM e""",
)
def eta_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return estimate.default(_requests(spark, sf_dir))


@registry.add(
    "eta_cost",
    f"""WITH {_REQUESTS}, t AS (SELECT id, rows * columns * CASE chain_type WHEN 'sentiment' THEN 10 WHEN 'entity' THEN 25 WHEN 'classification' THEN 8 ELSE 15 END AS tokens FROM requests)
        SELECT id, CAST(tokens AS BIGINT) AS tokens, round(tokens / 1000 * 0.1::DOUBLE, 6) AS cost FROM t""",
)
def eta_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, columns, chain = F.col("rows"), F.col("columns"), F.col("chain_type")
    requests = _requests(spark, sf_dir)
    return requests.select("id", estimate.tokens(rows, columns, chain).cast("long").alias("tokens"), F.round(estimate.cost(rows, columns, chain), 6).alias("cost"))


_RATES = "rates AS (SELECT chain_type, avg(rows * columns / (elapsed_ms / 1000)) AS rate, stddev_pop(rows * columns / (elapsed_ms / 1000)) AS spread FROM samples GROUP BY 1)"
_FITTED = f"""fitted AS (SELECT r.*, CAST(floor(r.rows * r.columns / (rate / ({_MULTIPLIER}))) AS BIGINT) AS seconds, spread / (rate / ({_MULTIPLIER})) AS factor FROM requests r LEFT JOIN rates USING (chain_type))"""


@registry.add(
    "eta_regression",
    f"""WITH {_REQUESTS}, {_SAMPLES}, {_RATES}, {_FITTED}
        SELECT id, rows, columns, chain_type, seconds, CAST(floor(greatest(seconds * (1 - factor), 0)) AS BIGINT) AS lower, CAST(floor(seconds * (1 + factor)) AS BIGINT) AS upper FROM fitted""",
)
def eta_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return estimate.regression(_requests(spark, sf_dir), _samples(spark, sf_dir))


_SIMILAR = f"""similar_runs AS (SELECT *, abs(row_count - 20000) + abs(column_count - 3) AS distance FROM history
    WHERE chain_type = 'sentiment' AND created_at > {_NOW} - INTERVAL 30 DAYS ORDER BY distance, id LIMIT 5)"""


@registry.add("eta_similar", f"WITH {_HISTORY}, {_SIMILAR} SELECT id, row_count, column_count, actual_seconds, distance FROM similar_runs")
def eta_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = _history(spark, sf_dir)
    return estimate.similar(history, 20_000, 3, "sentiment", _now(history)).select("id", "row_count", "column_count", "actual_seconds", "distance")


@registry.add(
    "eta_historical",
    f"""WITH {_HISTORY}, {_SIMILAR}, w AS (SELECT *, CAST(actual_seconds AS DOUBLE) AS t, CASE WHEN actual_seconds IS NOT NULL THEN least(20000 / row_count, row_count / 20000) * least(3 / column_count, column_count / 3) END AS w FROM similar_runs),
        e AS (SELECT CAST(floor(CASE WHEN sum(w) > 0 THEN sum(t * w) / sum(w) ELSE sum(t) / count(*) END) AS BIGINT) AS seconds FROM w),
        s AS (SELECT sqrt(sum((t - (SELECT seconds FROM e)) ** 2) / count(*)) AS spread FROM w)
        SELECT seconds, CAST(floor(greatest(seconds - spread, 0)) AS BIGINT) AS lower, CAST(floor(seconds + spread) AS BIGINT) AS upper FROM e, s""",
)
def eta_historical(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = _history(spark, sf_dir)
    return estimate.historical(estimate.similar(history, 20_000, 3, "sentiment", _now(history)), 20_000, 3)


@registry.add(
    "eta_accuracy",
    f"""WITH {_HISTORY}, e AS (SELECT abs(actual_seconds - estimated_seconds) / estimated_seconds AS e FROM history WHERE actual_seconds IS NOT NULL AND created_at > {_NOW} - INTERVAL 30 DAYS)
        SELECT count(*) AS total, round(avg(e), 6) AS average, round(quantile_cont(e, 0.5), 6) AS median FROM e""",
)
def eta_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = _history(spark, sf_dir)
    return estimate.accuracy(history, _now(history))


@registry.add(
    "eta_dispatch",
    f"""WITH {_REQUESTS}, {_SAMPLES}, {_HISTORY}, {_RATES}, {_FITTED},
        seen AS (SELECT chain_type, row_count AS rows, column_count AS columns, CAST(floor(avg(actual_seconds)) AS BIGINT) AS seen FROM history WHERE actual_seconds IS NOT NULL GROUP BY 1, 2, 3)
        SELECT f.id, f.rows, f.columns, f.chain_type, coalesce(s.seen, f.seconds, CAST(floor(f.rows * f.columns / 100) AS BIGINT)) AS seconds,
               CASE WHEN s.seen IS NOT NULL THEN 'historical' WHEN f.seconds IS NOT NULL THEN 'regression' ELSE 'default' END AS method
        FROM fitted f LEFT JOIN seen s USING (chain_type, rows, columns)""",
)
def eta_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return estimate.dispatch(_requests(spark, sf_dir), _samples(spark, sf_dir), _history(spark, sf_dir))


_RECENT_SQL = f"WITH {_HISTORY}"


@registry.add("eta_recent", f"{_RECENT_SQL} SELECT id, chain_type FROM (SELECT *, row_number() OVER (PARTITION BY chain_type ORDER BY created_at DESC, id DESC) AS place FROM history) WHERE place <= 1000")
def eta_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs that rates are taken from: the last thousand of each kind."""
    return estimate.recent(_history(spark, sf_dir), ["created_at", "id"]).select("id", "chain_type")


@registry.add("eta_record", f"{_RECENT_SQL} SELECT id, CASE WHEN actual_seconds IS NULL AND id % 2 = 0 THEN id % 77 ELSE actual_seconds END AS actual_seconds FROM history")
def eta_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = _history(spark, sf_dir)
    ended = history.where("id % 2 = 0").select("id", (F.col("id") % 77).alias("actual_seconds"))
    return estimate.recorded(history, ended).select("id", "actual_seconds")


@registry.add("eta_cleanup", f"{_RECENT_SQL} SELECT id FROM history WHERE created_at >= {_NOW} - INTERVAL 90 DAY")
def eta_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = _history(spark, sf_dir)
    return estimate.kept(history, _now(history)).select("id")


@registry.add("json_fields", "SELECT event_id, 'k' AS field, json_extract_string(props, '$.k') AS text FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the events' properties say of two keys, one of which none has."""
    events = tables.parquet(spark, sf_dir, "events")
    return events.select("event_id", F.explode(score.json_fields(F.col("props"), ["k", "none"])).alias("x")).select("event_id", "x.*")


@registry.add(
    "customer_records",
    """SELECT o_orderkey AS prompt, printf('CUST-%06d', o_orderkey % 1000000 + n) AS customer_id, (o_orderkey + n) % 7 AS support_tickets, CASE WHEN n = 1 THEN (o_orderkey + n) % 4 ELSE 0 END AS payment_delays
       FROM orders, (SELECT unnest([0, 1]) AS n)""",
)
def customer_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of two records each, of which the first does not name its delays."""
    k = F.col("o_orderkey")
    record = lambda n, *rest: F.concat(F.format_string("CUST-%06d", k % 1000000 + n), F.lit(" with support_tickets: "), ((k + n) % 7).cast("string"), *rest)
    delays = [F.lit(", payment_delays = "), ((k + 1) % 4).cast("string"), F.lit(".")]
    prompt = F.concat(F.lit("Score these:\n"), record(0), F.lit("\n"), record(1, *delays))
    return _orders(spark, sf_dir).select(k.alias("prompt"), F.explode(score.customer_records(prompt)).alias("r")).select("prompt", "r.*")


@registry.add(
    "canned_answers",
    """SELECT o_orderkey AS id, (['generic', 'medical', 'fraud'])[o_orderkey % 3 + 1] AS kind,
         (['{"status": "ok"}', '{"risk_level": "moderate", "follow_up": "yes"}', '{"risk_score": "0.25", "flagged": "no"}'])[o_orderkey % 3 + 1] AS answer FROM orders""",
)
def canned_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    asks = F.element_at(F.array(F.lit("Hello"), F.lit("Patient 7: which diagnosis?"), F.lit("Is this TRANSACTION odd?")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return _orders(spark, sf_dir).select(F.col("o_orderkey").alias("id"), score.canned_answer(asks).alias("a")).select("id", "a.kind", "a.answer")


def _refusing(texts: list[str]) -> list[float]:
    """A stand-in for an outside scorer, which refuses some texts."""
    if any(len(t) % 7 == 0 for t in texts):
        raise ScorerError("refused")
    return [len(t) / 10 for t in texts]


@registry.add(
    "scorer_errors",
    "SELECT c_custkey AS id, CASE WHEN length(c_name || c_mktsegment) % 7 = 0 THEN NULL ELSE length(c_name || c_mktsegment) / 10 END AS score, CASE WHEN length(c_name || c_mktsegment) % 7 = 0 THEN 'ScorerError: refused' END AS error FROM customer",
)
def scorer_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores one by one, with what was refused after two more tries told in a column."""
    rows = tables.parquet(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat("c_name", "c_mktsegment").alias("text"))
    return score.with_scorer(rows, "text", _refusing, batch=1, retries=2, wait=0.0, keep_errors=True).drop("text")


_PRIVATE = "'mail ' || email || ' or call ' || phone || ' ssn ' || ssn || ' card 4' || lpad(CAST(id AS VARCHAR), 15, '0') || ' ip 10.1.2.' || (id % 256) || ' born 1990-12-31'"


@registry.add("score_hidden", f"WITH {CONTACTS} SELECT id, {_PRIVATE} AS text, 6.0::DOUBLE AS score FROM contacts")
def score_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an outside scorer sees of texts with six kinds of private values: six tokens and none of the values."""
    parts = [
        F.lit("mail "), "email", F.lit(" or call "), "phone", F.lit(" ssn "), "ssn", F.lit(" card 4"), F.lpad(F.col("id").cast("string"), 15, "0"),
        F.lit(" ip 10.1.2."), (F.col("id") % 256).cast("string"), F.lit(" born 1990-12-31"),
    ]
    texts = tables.contacts(tables.spread(tables.parquet(spark, sf_dir, "customer").select("c_custkey"))).select("id", F.concat(*parts).alias("text"))
    return Sablefin(spark).score(texts, "text", _tokens_seen)


def _tokens_seen(texts: list[str]) -> list[float]:
    """A scorer for tests: the number of tokens in a text, below 0 if a private value is left in it."""
    left = re.compile(r"@example|(?<![0-9])555-|(?<![0-9])10\.1\.|1990-12|(?<![0-9-])[0-9]{16}(?![0-9\]])|(?<![0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}")
    return [-1.0 if left.search(t) else float(t.count("[")) for t in texts]


def _lengths(texts: list[str]) -> list[float]:
    """A scorer for tests, which answers the later the longer a text is."""
    return [float(len(t)) for t in texts]


@registry.add("scorer_in_flight", "SELECT c_custkey AS id, length(c_name || c_mktsegment)::DOUBLE AS score FROM customer")
def scorer_in_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five calls at once in each task, under one quota for all tasks."""
    rows = tables.parquet(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat("c_name", "c_mktsegment").alias("text"))
    return score.with_scorer(rows, "text", _lengths, batch=50, in_flight=5, per_second_in_all=1000.0).drop("text")
