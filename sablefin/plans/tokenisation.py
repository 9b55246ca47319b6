"""Queries of tokenisation, its dictionaries, the way back, and caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sablefin.functions.patterns import TEXT_RULES, TOKEN_PREFIXES, default_pii
from sablefin.functions.validators import CARD_REGEX, MAX_TEXT_BYTES
from sablefin.operators import tokenise
from sablefin.sources import scratch, tables

from .common import CONTACTS, Registry, quoted
from .detection import emails_sql, luhn_sql

registry = Registry()
_SEALING_KEY = bytes(range(32))


def _contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.contacts(tables.spread(tables.parquet(spark, sf_dir, "customer").select("c_custkey")))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.spread(tables.parquet(spark, sf_dir, "documents").select("doc_id", "text"))


def _numbers(df: DataFrame) -> DataFrame:
    return tokenise.dictionary(df, "id", "note", default_pii())


def _counter(df: DataFrame) -> DataFrame:
    found = _numbers(df)
    return found.withColumn("token", tokenise.counter_token(F.col("pattern_type"), F.col("number")))


def _bounded(df: DataFrame) -> DataFrame:
    found = _numbers(df)
    return found.withColumn("token", tokenise.bounded_token(F.col("pattern_type"), F.col("number")))


def _chain_sql(token: str, source: str = "SELECT id, note AS t FROM contacts") -> str:
    """DuckDB: marks, matches and dictionary of the contacts' notes (or of another source of ids and texts), rule by rule."""
    rules = default_pii().by_priority()
    steps = [CONTACTS, f"s0 AS ({source})"]
    for k, rule in enumerate(rules):
        kept = ", ".join(f"f{i}" for i in range(k))
        kept = f"{kept}, " if kept else ""
        regex = quoted(rule.regex)
        steps.append(f"s{k + 1} AS (SELECT id, {kept}regexp_extract_all(t, {regex}) AS f{k}, regexp_replace(t, {regex}, chr({0xE000 + k}), 'g') AS t FROM s{k})")
    n = len(rules)
    places = " UNION ALL ".join(f"SELECT id, {k} AS rule, unnest(range(len(f{k}))) AS position, unnest(f{k}) AS original FROM s{n}" for k in range(n))
    names = ", ".join(quoted(r.pattern_type) for r in rules)
    steps.append(f"places AS ({places})")
    steps.append("firsts AS (SELECT original, min({'id': id, 'rule': rule, 'position': position}) AS place FROM places GROUP BY original)")
    steps.append(f"numbers AS (SELECT original, ([{names}])[place.rule + 1] AS pattern_type, row_number() OVER (ORDER BY place) - 1 AS number FROM firsts)")
    steps.append(f"dictionary AS (SELECT *, {token} AS token FROM numbers)")
    steps.append("maps AS (SELECT id, map_from_entries(list(DISTINCT {'k': original, 'v': token})) AS m FROM places JOIN dictionary USING (original) GROUP BY id)")
    text = "t"
    for k in range(n):
        own = f"list_transform(f{k}, lambda x: m[x])"
        pieces = f"string_split({text}, chr({0xE000 + k}))"
        text = f"array_to_string(list_transform({pieces}, lambda p, i: p || coalesce(({own})[i], '')), '')"
    steps.append(f"done AS (SELECT id, {text} AS note FROM s{n} LEFT JOIN maps USING (id))")
    return "WITH " + ", ".join(steps)


_COUNTER = "'[' || pattern_type || '-' || number || ']'"
_PREFIX = "CASE pattern_type " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in TOKEN_PREFIXES.items()) + " ELSE '' END"
_BOUNDED = f"({_PREFIX}) || printf('%08X', number)"


@registry.add("tokenise_counter", _chain_sql(_COUNTER) + " SELECT id, note FROM done")
def tokenise_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _contacts(spark, sf_dir)
    return tokenise.tokenise(df, "id", "note", _counter(df), default_pii()).select("id", "note")


@registry.add("tokenise_bounded", _chain_sql(_BOUNDED) + " SELECT id, note FROM done")
def tokenise_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _contacts(spark, sf_dir)
    return tokenise.tokenise(df, "id", "note", _bounded(df), default_pii()).select("id", "note")


_RECORDS = ["email", "ssn", "phone", "note"]
_CELLS_SQL = f"""SELECT {{'row': id, 'col': c}} AS id, t FROM (SELECT id, unnest(range({len(_RECORDS)})) AS c, unnest([{', '.join(_RECORDS)}]) AS t FROM contacts)"""
_TURNED_SQL = ", ".join(f"max(CASE WHEN id.col = {i} THEN note END) AS {c}" for i, c in enumerate(_RECORDS))


@registry.add("obfuscate_records", _chain_sql(_COUNTER, _CELLS_SQL) + f" SELECT id.row AS id, {_TURNED_SQL} FROM done GROUP BY 1")
def obfuscate_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All text columns of the contacts, with one dictionary."""
    df = _contacts(spark, sf_dir)
    tokens = tokenise.record_dictionary(df, "id", _RECORDS, default_pii())
    tokens = tokens.withColumn("token", tokenise.counter_token(F.col("pattern_type"), F.col("number")))
    return tokenise.tokenise_columns(df, "id", _RECORDS, tokens, default_pii()).drop("tokens_used")


@registry.add(
    "merge_dictionary",
    _chain_sql(_COUNTER, "SELECT id, note AS t FROM contacts")
    + """, known AS (SELECT original, pattern_type, number FROM dictionary WHERE number < 100),
         fresh AS (SELECT original, pattern_type, row_number() OVER (ORDER BY number) + (SELECT max(number) FROM known) AS number FROM dictionary WHERE number >= 100)
       SELECT * FROM known UNION ALL SELECT * FROM fresh""",
)
def merge_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred entries, kept from before, with all that the notes hold."""
    found = scratch.written(_numbers(_contacts(spark, sf_dir)), "dictionary")
    return tokenise.merged_dictionary(found.where("number < 100"), found)


@registry.add("detokenise", f"WITH {CONTACTS} SELECT id, note FROM contacts")
def detokenise(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _contacts(spark, sf_dir)
    tokens = _counter(df)
    done = scratch.written(tokenise.tokenise(df, "id", "note", tokens, default_pii()).select("id", "note"), "tokenised")
    return tokenise.detokenise(done, "id", "note", tokens).select("id", "note")


@registry.add("detokenise_bounded", f"WITH {CONTACTS} SELECT id, note FROM contacts")
def detokenise_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _contacts(spark, sf_dir)
    tokens = _bounded(df)
    done = scratch.written(tokenise.tokenise(df, "id", "note", tokens, default_pii()).select("id", "note"), "tokenised")
    return tokenise.detokenise(done, "id", "note", tokens, tokenise.BOUNDED_REGEX).select("id", "note")


@registry.add("token_stats", _chain_sql(_COUNTER) + f" SELECT count(*) AS total_tokens, {len(default_pii())} AS patterns_loaded, max(number) + 1 AS next_token_id FROM dictionary")
def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = tokenise.cache_stats(_counter(_contacts(spark, sf_dir)))
    return stats.select(F.col("entries").alias("total_tokens"), F.lit(len(default_pii())).alias("patterns_loaded"), F.col("next_number").alias("next_token_id"))


@registry.add(
    "token_cache_stats",
    _chain_sql(_COUNTER)
    + " SELECT count(*) AS entries, max(number) + 1 AS next_number, CAST(sum(strlen(token) + strlen(original) + strlen(pattern_type) + 32) AS BIGINT) AS bytes FROM dictionary",
)
def token_cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenise.cache_stats(_counter(_contacts(spark, sf_dir)))


def _hash_sql(original: str, label: str) -> str:
    return f"'[{label}-' || CAST(CAST('0x' || substr(md5({original} || '|{label}'), 1, 15) AS BIGINT) AS VARCHAR) || ']'"


def _replaced_sql(text: str, matches: str, label: str) -> str:
    return f"list_reduce(list_prepend({text}, {matches}), lambda acc, m: replace(acc, m, {_hash_sql('m', label)}))"


def _in_steps_sql(table: str, key: str, column: str, guarded: bool = True) -> str:
    """DuckDB: the text engine as a chain of subqueries over a table, with or without its guards."""
    most = "[1:1000]" if guarded else ""
    first, second = TEXT_RULES
    regex_1, regex_2 = quoted(first[1]), quoted(second[1])
    one = f"SELECT {key}, {column} AS t, {_replaced_sql(column, f'(regexp_extract_all({column}, {regex_1})){most}', first[0])} AS u FROM {table}"
    two = f"SELECT {key}, t, {_replaced_sql('u', f'(regexp_extract_all(u, {regex_2})){most}', second[0])} AS v FROM ({one})"
    return f"SELECT {key}, {f'CASE WHEN strlen(t) > {MAX_TEXT_BYTES} THEN t ELSE v END' if guarded else 'v'} AS {column} FROM ({two})"


@registry.add("tokenise_text", _in_steps_sql("documents", "doc_id", "text"))
def tokenise_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", tokenise.tokenise_text(F.col("text")).alias("text"))


_LONG_TEXTS = "(SELECT doc_id, repeat(text || ' a' || doc_id || '@example.com 123-45-6789 ', 1 + CAST(doc_id % 40 AS INT)) AS text FROM documents)"


@registry.add("tokenise_text_exact", f"SELECT doc_id, strlen(text) AS bytes, md5(text) AS digest FROM ({_in_steps_sql(_LONG_TEXTS, 'doc_id', 'text', guarded=False)})")
def tokenise_text_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of up to 40 copies, with nothing left in them however long they are."""
    more = F.concat("text", F.lit(" a"), F.col("doc_id").cast("string"), F.lit("@example.com 123-45-6789 "))
    long = _texts(spark, sf_dir).select("doc_id", F.repeat(more, (F.col("doc_id") % 40 + 1).cast("int")).alias("text"))
    done = tokenise.tokenise_text(F.col("text"), most_bytes=None, most_matches=None)
    return long.select("doc_id", done.alias("text")).select("doc_id", F.octet_length("text").cast("long").alias("bytes"), F.md5(F.col("text").cast("binary")).alias("digest"))


_CARDS = f"list_filter(regexp_extract_all(u, {quoted(CARD_REGEX)}), lambda c: {luhn_sql('c')})"
_OTHERS = f"(regexp_extract_all(v, {quoted(TEXT_RULES[1][1])}))[1:1000]"
_SECURE_SQL = f"""
WITH a AS (SELECT doc_id, text, {_replaced_sql('text', emails_sql('text'), 'EMAIL')} AS u FROM documents),
b AS (SELECT doc_id, text, {_replaced_sql('u', _CARDS, 'CREDIT_CARD')} AS v FROM a),
c AS (SELECT doc_id, text, {_replaced_sql('v', _OTHERS, 'SSN')} AS w FROM b)
SELECT doc_id, CASE WHEN strlen(text) > {MAX_TEXT_BYTES} THEN text ELSE w END AS text FROM c"""


@registry.add("tokenise_secure", _SECURE_SQL)
def tokenise_secure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", tokenise.tokenise_secure(F.col("text")).alias("text"))


_NOTE_TOKENS = f"""WITH {CONTACTS}, found AS (
  SELECT unnest(regexp_extract_all(line, {quoted(TEXT_RULES[0][1])})) AS original, 'EMAIL' AS label FROM (SELECT note || ' ' || ssn AS line FROM contacts)
  UNION ALL SELECT unnest(regexp_extract_all(line, {quoted(TEXT_RULES[1][1])})), 'SSN' FROM (SELECT note || ' ' || ssn AS line FROM contacts))
SELECT DISTINCT original, label, CASE label WHEN 'EMAIL' THEN {_hash_sql('original', 'EMAIL')} ELSE {_hash_sql('original', 'SSN')} END AS token FROM found"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contacts(spark, sf_dir).select("id", F.concat("note", F.lit(" "), "ssn").alias("line"))


@registry.add("token_dictionary", _NOTE_TOKENS)
def token_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenise.text_tokens(_lines(spark, sf_dir), "line")


@registry.add("hash_tokens", f"WITH {CONTACTS} SELECT id, {_hash_sql('ssn', 'SSN')} AS token FROM contacts")
def hash_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contacts(spark, sf_dir).select("id", tokenise.hash_token(F.col("ssn"), "SSN").alias("token"))


@registry.add("detokenise_text", f"WITH {CONTACTS} SELECT id, note || ' ' || ssn AS line FROM contacts")
def detokenise_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    done = lines.select("id", tokenise.tokenise_text(F.col("line")).alias("line"))
    return tokenise.detokenise(done, "id", "line", tokenise.text_tokens(lines, "line")).select("id", "line")


_CUSTOMERS_SQL = """customers AS (
  SELECT printf('CUST-%06d', i) AS customer_id, 'customer' || i || '@example.com' AS email,
         printf('555-%03d-%04d', i % 900 + 100, i % 10000) AS phone, printf('2024-%02d-%02d', i % 12 + 1, i % 28 + 1) AS last_purchase,
         i % 7 AS support_tickets, CASE WHEN i % 4 = 0 THEN i % 4 ELSE 0 END AS payment_delays, i % 200 + 50 AS monthly_usage
  FROM (SELECT c_custkey AS i FROM customer) t)"""


@registry.add(
    "tokenise_records",
    f"WITH {_CUSTOMERS_SQL} SELECT customer_id AS record_id, {_hash_sql('email', 'EMAIL')} AS email, phone, {_hash_sql('email', 'EMAIL')} AS tokens_used FROM customers",
)
def tokenise_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = tokenise.tokenise_records(tables.churn_customers(tables.parquet(spark, sf_dir, "customer"), "c_custkey"), ["email", "phone"])
    return done.withColumn("tokens_used", F.array_join("tokens_used", ","))


@registry.add(
    "tokenise_nested",
    f"""WITH {CONTACTS} SELECT id, '{{"user":{{"email":"' || {_hash_sql('email', 'EMAIL')} || '","ssn":"' || {_hash_sql('ssn', 'SSN')} || '","age":'
        || (id % 90) || '}},"contacts":[{{"email":"' || {_hash_sql('email', 'EMAIL')} || '"}}]}}' AS record FROM contacts""",
)
def tokenise_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.struct("email", "ssn", (F.col("id") % 90).alias("age")).alias("user")
    records = _contacts(spark, sf_dir).select("id", F.struct(user, F.array(F.struct("email")).alias("contacts")).alias("record"))
    return records.select("id", F.to_json(tokenise.tokenise_nested(F.col("record"), records.schema["record"].dataType)).alias("record"))


_JSON_RECORDS = f"""records AS (
  SELECT 'event' || event_id AS key, props AS record, props AS hidden FROM events
  UNION ALL
  SELECT 'contact' || id, replace(shape, '?', email), replace(shape, '?', {_hash_sql('email', 'EMAIL')}) FROM (
    SELECT id, email, CASE id % 5
      WHEN 0 THEN '{{"who?":{{"mail" : ["?",' || id || ',null,true,{{"deep":[["?"]]}}]}},"n":1.50}}'
      WHEN 1 THEN '["to ? and \\\"?\\\"", -1e5, "?",{{}}]'
      WHEN 2 THEN '"?"'
      WHEN 3 THEN '{{"at":"2024-01-01","caf\\u00e9":"na\\u00efve ","id":' || (id + 100000000) || '}}'
      ELSE 'no json: ?' END AS shape FROM contacts))"""


@registry.add("tokenise_json", f"WITH {CONTACTS}, {_JSON_RECORDS} SELECT key, CASE WHEN record LIKE '%\"who%' THEN replace(hidden, 'who' || {_hash_sql('mail', 'EMAIL')}, 'who' || mail) ELSE hidden END AS record FROM (SELECT *, 'customer' || substr(key, 8) || '@example.com' AS mail FROM records)")
def tokenise_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON of no common shape: names, numbers, blanks and what isn't a string stay, strings are tokenised at any depth."""
    number = F.col("id") % 5
    shapes = [
        F.concat(F.lit('{"who?":{"mail" : ["?",'), F.col("id").cast("string"), F.lit(',null,true,{"deep":[["?"]]}]},"n":1.50}')),
        F.lit('["to ? and \\"?\\"", -1e5, "?",{}]'),
        F.lit('"?"'),
        F.concat(F.lit('{"at":"2024-01-01","caf\\u00e9":"na\\u00efve ","id":'), (F.col("id") + 100000000).cast("string"), F.lit("}")),
        F.lit("no json: ?"),
    ]
    shape = F.when(number == 0, shapes[0]).when(number == 1, shapes[1]).when(number == 2, shapes[2]).when(number == 3, shapes[3]).otherwise(shapes[4])
    contacts = _contacts(spark, sf_dir).select(F.concat(F.lit("contact"), F.col("id").cast("string")).alias("key"), F.replace(shape, F.lit("?"), F.col("email")).alias("record"))
    events = tables.parquet(spark, sf_dir, "events").select(F.concat(F.lit("event"), F.col("event_id").cast("string")).alias("key"), F.col("props").alias("record"))
    return events.union(contacts).select("key", tokenise.tokenise_json(F.col("record")).alias("record"))


_LITERALS = "note || ' [EMAIL-' || (id % 50) || '] EMAIL_' || printf('%08X', id % 50) || ' [LITERAL-0] [SSN-1'"


@registry.add("restore_literals", f"WITH {CONTACTS} SELECT id, {_LITERALS} AS note, {_LITERALS} AS bounded, true AS hidden FROM contacts")
def restore_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes that hold other rows' tokens as text, tokenised by both engines and restored; ``hidden``: none was seen meanwhile."""
    number = F.col("id") % 50
    note = F.concat("note", F.lit(" [EMAIL-"), number.cast("string"), F.lit("] EMAIL_"), F.format_string("%08X", number), F.lit(" [LITERAL-0] [SSN-1"))
    df = _contacts(spark, sf_dir).select("id", note.alias("note"))
    tokens = scratch.written(_numbers(df), "dictionary")
    out = None
    for name, token, regex in (("note", tokenise.counter_token, tokenise.TOKEN_REGEX), ("bounded", tokenise.bounded_token, tokenise.BOUNDED_REGEX)):
        own = tokens.withColumn("token", token(F.col("pattern_type"), F.col("number")))
        done = tokenise.tokenise(df, "id", "note", own, default_pii()).withColumn("hidden", ~F.col("note").rlike("@example"))
        done = scratch.written(done.drop("tokens_used"), "tokenised")
        back = tokenise.detokenise(done, "id", "note", own, regex).select("id", F.col("note").alias(name), "hidden")
        out = back if out is None else out.join(back.withColumnRenamed("hidden", "also"), "id").select("id", "note", "bounded", (F.col("hidden") & F.col("also")).alias("hidden"))
    return out


@registry.add(
    "obfuscate_summary",
    _chain_sql(_COUNTER)
    + f""" SELECT 'dry_run' AS mode, (SELECT count(*) FROM contacts) AS records, {len(default_pii())} AS patterns_loaded, count(*) AS tokens_generated,
           string_agg(DISTINCT pattern_type, ',' ORDER BY pattern_type) AS types, (SELECT note FROM done ORDER BY id LIMIT 1) AS first_sample FROM dictionary""",
)
def obfuscate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _contacts(spark, sf_dir)
    tokens = _counter(df)
    done = tokenise.tokenise(df, "id", "note", tokens, default_pii())
    counts = done.agg(F.count("*").alias("records"), F.min_by("note", "id").alias("first_sample"))
    kinds = tokens.agg(F.count("*").alias("tokens_generated"), F.array_join(F.sort_array(F.collect_set("pattern_type")), ",").alias("types"))
    both = counts.crossJoin(F.broadcast(kinds))  # one row each
    return both.select(F.lit("dry_run").alias("mode"), "records", F.lit(len(default_pii())).alias("patterns_loaded"), "tokens_generated", "types", "first_sample")


@registry.add("crypto_roundtrip", f"WITH {CONTACTS} SELECT id, strlen(note) + 28 AS sealed_bytes, note AS opened FROM contacts")
def crypto_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    shut = _contacts(spark, sf_dir).select("id", tokenise.sealed(F.col("note"), _SEALING_KEY).alias("sealed"))
    return shut.select("id", F.octet_length("sealed").cast("long").alias("sealed_bytes"), tokenise.opened(F.col("sealed"), _SEALING_KEY).alias("opened"))


@registry.add("token_dict_persist", _chain_sql(_COUNTER) + " SELECT original, pattern_type, number, token FROM dictionary")
def token_dict_persist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary, sealed, written, read back and opened."""
    tokens = _counter(_contacts(spark, sf_dir))
    kept = scratch.written(tokens.withColumn("original", tokenise.sealed(F.col("original"), _SEALING_KEY)), "dictionary")
    return kept.withColumn("original", tokenise.opened(F.col("original"), _SEALING_KEY))


@registry.add(
    "lru_survivors",
    """WITH last AS (SELECT user_id, max(ts) AS last_used, max(strlen(props)) AS bytes FROM events GROUP BY user_id),
       alive AS (SELECT * FROM last WHERE epoch((SELECT max(ts) FROM events)) - epoch(last_used) <= 86400 * 20),
       newest AS (SELECT * FROM alive ORDER BY last_used DESC, user_id LIMIT 500)
       SELECT user_id, last_used, bytes, running_bytes FROM (
         SELECT *, CAST(sum(bytes) OVER (ORDER BY last_used DESC, user_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_bytes FROM newest)
       WHERE running_bytes <= 4096""",
)
def lru_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = tables.parquet(spark, sf_dir, "events")
    now = events.agg(F.max("ts")).scalar()
    return tokenise.survivors(events, "user_id", "ts", F.octet_length("props"), now, entries=500, budget=4096, ttl_seconds=86400 * 20)
