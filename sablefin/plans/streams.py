"""Queries of sampling, merging and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sablefin.functions.patterns import LIBRARY, default_pii
from sablefin.operators import sampling, tokenise
from sablefin.operators.tokenise import tokenise_text
from sablefin.sources import scratch, tables
from sablefin.streaming import detection as streaming
from sablefin.streaming import state

from .common import CONTACTS, Registry, count_sql, quoted
from .tokenisation import _COUNTER, _chain_sql, _in_steps_sql

registry = Registry()
COLUMNS = ["email", "ssn", "phone"]
BATCHES = 10


def _contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.contacts(tables.parquet(spark, sf_dir, "customer"))


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contacts dealt to ten batches by key."""
    return sampling.batch_counts(_contacts(spark, sf_dir), F.col("id") % BATCHES, COLUMNS)


_COUNTS_SQL = f"WITH {CONTACTS}, counts AS (" + " UNION ALL ".join(
    f"SELECT id % {BATCHES} AS batch, {quoted(c)} AS column_name, {quoted(t)} AS pattern_type, CAST(sum({count_sql(c, r)}) AS BIGINT) AS matches, count(*) AS rows FROM contacts GROUP BY 1"
    for c in COLUMNS
    for t, r in LIBRARY.items()
)
_COUNTS_SQL += ")"
_PROGRESS_SQL = f"""{_COUNTS_SQL}, per AS (SELECT batch, max(rows) AS rows, sum(matches) AS matches FROM counts GROUP BY 1),
  kinds AS (SELECT batch, count(*) AS n FROM (SELECT pattern_type, min(batch) AS batch FROM counts WHERE matches > 0 GROUP BY 1) GROUP BY 1),
  columns AS (SELECT batch, count(*) AS n FROM (SELECT column_name, min(batch) AS batch FROM counts WHERE matches > 0 GROUP BY 1) GROUP BY 1),
  run AS (SELECT per.batch, CAST(sum(rows) OVER w AS BIGINT) AS rows_processed, CAST(sum(matches) OVER w AS BIGINT) AS patterns_found,
    CAST(sum(coalesce(k.n, 0)) OVER w AS BIGINT) AS kinds, CAST(sum(coalesce(c.n, 0)) OVER w AS BIGINT) AS columns
    FROM per LEFT JOIN kinds k ON k.batch = per.batch LEFT JOIN columns c ON c.batch = per.batch WINDOW w AS (ORDER BY per.batch ROWS UNBOUNDED PRECEDING)),
  progress AS (SELECT *, round(least(0.5 * CASE WHEN kinds > 0 THEN least(patterns_found * 100 / rows_processed, 1) ELSE 0 END + 0.3 * least(kinds / 12, 1) + 0.2 * least(columns / 10, 1), 1), 6) AS confidence FROM run)"""


@registry.add("merge_batches", f"{_COUNTS_SQL} SELECT pattern_type, CAST(sum(matches) AS BIGINT) AS matches, string_agg(DISTINCT column_name, ',' ORDER BY column_name) AS columns FROM counts WHERE matches > 0 GROUP BY 1")
def merge_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.merged(_counts(spark, sf_dir))


@registry.add(
    "merge_batches_stream",
    f"""{_COUNTS_SQL}, per AS (SELECT batch, pattern_type, sum(matches) AS matches, max(rows) AS rows FROM counts GROUP BY 1, 2 HAVING sum(matches) > 0)
        SELECT pattern_type, CAST(sum(matches) AS BIGINT) AS matches, arg_max(round(matches / rows, 6), batch) AS last_confidence FROM per GROUP BY 1""",
)
def merge_batches_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.merged_stream(_counts(spark, sf_dir))


@registry.add("stream_progress", f"{_PROGRESS_SQL} SELECT * FROM progress")
def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.progress(_counts(spark, sf_dir))


@registry.add(
    "plateau_stop",
    f"""{_PROGRESS_SQL} SELECT batch, confidence, count(*) OVER l = 3 AND avg(confidence) OVER l >= 0.5 AND var_pop(confidence) OVER l < 0.001 AS should_stop
        FROM progress WINDOW l AS (ORDER BY batch ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
)
def plateau_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.with_stop(sampling.progress(_counts(spark, sf_dir)), window=3, threshold=0.5).select("batch", "confidence", "should_stop")


def _stop_sql(progress: str, window: int, threshold: float) -> str:
    return f"""SELECT *, count(*) OVER l = {window} AND avg(confidence) OVER l >= {threshold} AND var_pop(confidence) OVER l < 0.001 AS should_stop
        FROM {progress} WINDOW l AS (ORDER BY batch ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW)"""


_LEAST, _FACTOR, _THRESHOLD = 100, 1.5, 0.5
#: The contacts' ids dealt to parts of 100, 150, 225, ... rows along a hash of the id.
_PARTS_SQL = f"""RECURSIVE sizes AS (SELECT count(*) AS total, least(count(*), 100000) AS upto FROM customer),
  parts AS (SELECT 0 AS batch, 0.0::DOUBLE AS low, least({_LEAST}.0::DOUBLE, upto) AS high, {_LEAST}.0::DOUBLE AS size FROM sizes
    UNION ALL SELECT batch + 1, high, least(high + size * {_FACTOR}, upto), size * {_FACTOR} FROM parts, sizes WHERE high < upto),
  bounds AS (SELECT batch, CAST(floor(low / total * {sampling.PLACES}) AS BIGINT) AS low, CAST(floor(high / total * {sampling.PLACES}) AS BIGINT) + CASE WHEN high = total THEN 1 ELSE 0 END AS high FROM parts, sizes)"""
_DEALT_SQL = "(SELECT c.*, b.batch FROM contacts c JOIN bounds b ON CAST('0x' || substr(md5(CAST(c.id AS VARCHAR)), 1, 7) AS BIGINT) >= b.low AND CAST('0x' || substr(md5(CAST(c.id AS VARCHAR)), 1, 7) AS BIGINT) < b.high)"
_ADAPTIVE_SQL = _PROGRESS_SQL.replace("WITH contacts", f"WITH {_PARTS_SQL}, contacts", 1).replace(f"id % {BATCHES} AS batch", "batch").replace("FROM contacts GROUP BY", f"FROM {_DEALT_SQL} GROUP BY")


@registry.add("adaptive_sample", f"{_ADAPTIVE_SQL}, stops AS ({_stop_sql('progress', 3, _THRESHOLD)}) SELECT * FROM stops WHERE batch <= (SELECT coalesce(min(batch), 1000000) FROM stops WHERE should_stop)")
def adaptive_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of the contacts until detection settles: a sampling operator, so it reads no more than it needs."""
    return sampling.adaptive(_contacts(spark, sf_dir), "id", COLUMNS, sampling.SamplingConfig(least=_LEAST, factor=_FACTOR, threshold=_THRESHOLD))


@registry.add("stream_detect", f"{_PROGRESS_SQL} {_stop_sql('progress', 5, 0.95)}")
def stream_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contacts as a stream of ten files, written one after another; all of them, as the threshold is out of reach."""
    path = scratch.new_path(spark, "stream-source")
    contacts = _contacts(spark, sf_dir)
    for batch in range(BATCHES):
        contacts.where(F.col("id") % BATCHES == batch).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(contacts.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return streaming.detect_stream(stream, COLUMNS)


@registry.add(
    "detect_strategy",
    f"""{_PROGRESS_SQL}, stops AS ({_stop_sql('progress', 3, 0.5)})
        SELECT batch, CASE WHEN should_stop THEN 'EarlyStop' WHEN rows_processed >= 1000 THEN 'Fixed(1000)' WHEN batch = 0 THEN 'Progressive' ELSE 'Adaptive' END AS strategy FROM stops""",
)
def detect_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = sampling.with_stop(sampling.progress(_counts(spark, sf_dir)), window=3, threshold=0.5)
    return sampling.with_strategy(history, 1000).select("batch", "strategy")


_LINES_SQL = f"WITH {CONTACTS}, lines AS (SELECT id, note || ' ' || ssn AS line FROM contacts) SELECT line FROM ({_in_steps_sql('lines', 'id', 'line')})"


def _write_lines(spark: SparkSession, sf_dir: str) -> str:
    path = scratch.new_path(spark, "lines")
    _contacts(spark, sf_dir).select(F.concat("note", F.lit(" "), "ssn").alias("value")).repartition(4).write.text(path)
    return path


@registry.add("stream_lines", _LINES_SQL)
def stream_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text files, read by line, tokenised, written and read again."""
    done = spark.read.text(_write_lines(spark, sf_dir)).select(tokenise_text(F.col("value")).alias("value"))
    target = scratch.new_path(spark, "lines-done")
    done.write.text(target)
    return spark.read.text(target).withColumnRenamed("value", "line")


@registry.add("stream_tokenise", _LINES_SQL)
def stream_tokenise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream."""
    target = scratch.new_path(spark, "stream-done")
    streaming.tokenise_lines(spark, _write_lines(spark, sf_dir), target).awaitTermination()
    return spark.read.text(target).withColumnRenamed("value", "line")


@registry.add("src_csv_sample", f"WITH {CONTACTS} SELECT CAST(id AS VARCHAR) AS id, email, note FROM contacts ORDER BY CAST(id AS VARCHAR) LIMIT 100")
def src_csv_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred rows of a CSV file, all columns as strings."""
    path = scratch.new_path(spark, "csv")
    tables.write(_contacts(spark, sf_dir).select("id", "email", "note"), path, "csv")
    return tables.first_n(tables.csv(spark, path), "id", 100)


@registry.add("src_csv_stream", f"WITH {CONTACTS} SELECT id, email, note FROM contacts")
def src_csv_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of CSV files as a stream, written as a table."""
    path, target = scratch.new_path(spark, "csv"), scratch.new_path(spark, "csv-done")
    tables.write(_contacts(spark, sf_dir).select("id", "email", "note").repartition(4), path, "csv")
    stream = tables.csv_stream(spark, path, "id long, email string, note string")
    writer = stream.writeStream.format("parquet").option("checkpointLocation", scratch.new_path(spark, "csv-checkpoint"))
    writer.trigger(availableNow=True).start(target).awaitTermination()
    return spark.read.schema("id long, email string, note string").parquet(target)


_NOTES = "stream-notes"


def _written_notes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """The contacts' notes in five files, to be read as a stream."""
    path = scratch.new_path(spark, _NOTES)
    notes = _contacts(spark, sf_dir).select("id", "note")
    notes.repartition(5, "id").write.parquet(path)
    return notes, path


@registry.add("stream_dictionary", _chain_sql(_COUNTER) + " SELECT id, note, (SELECT count(*) FROM dictionary) AS entries, true AS hidden FROM contacts")
def stream_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notes tokenised as a stream in two runs, one file and then two in a batch, and restored with the dictionary that the
    state kept; ``entries``: its originals if each has one token, ``hidden``: no address was left meanwhile."""
    with scratch.temporary() as keep:
        notes, path = _written_notes(spark, sf_dir)
        target, kept, checkpoint = (scratch.new_path(spark, n) for n in ("stream-done", "stream-dictionary", "stream-checkpoint"))
        for files in (1, 2):
            stream = spark.readStream.schema(notes.schema).option("maxFilesPerTrigger", files).parquet(path)
            state.tokenise_stream(stream, "id", "note", default_pii(), target, kept, checkpoint, buckets=8).awaitTermination()
            notes.limit(0).write.mode("append").parquet(path)
        done, tokens = (spark.read.option("basePath", x).parquet(f"{x}/batch=*") for x in (target, kept))
        entries = tokens.agg(F.when((F.count_distinct("original") == F.count("*")) & (F.count_distinct("token") == F.count("*")), F.count("*")).alias("entries"))
        hidden = done.withColumn("hidden", ~F.col("note").rlike("@example"))
        back = tokenise.detokenise(hidden, "id", "note", tokens).select("id", "note", "hidden")
        out = keep(scratch.written(back.crossJoin(F.broadcast(entries)).select("id", "note", "entries", "hidden"), "stream-restored"))  # one row
        for folder in (path, target, kept, checkpoint):
            scratch.drop_path(spark, folder)
        return out


@registry.add("stream_quarantine", f"WITH {CONTACTS} SELECT id, CASE WHEN id % 7 = 0 THEN 'no JSON' WHEN id % 11 = 0 THEN 'too long' END AS error FROM contacts")
def stream_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as JSON lines, some cut short and some too long, as a stream; those are set aside with their error."""
    with scratch.temporary() as keep:
        path, target, aside, checkpoint = (scratch.new_path(spark, n) for n in (_NOTES, "stream-done", "stream-aside", "stream-checkpoint"))
        line = F.to_json(F.struct("note"))
        line = F.when(F.col("id") % 7 == 0, F.left(line, F.lit(9))).when(F.col("id") % 11 == 0, F.concat(line, F.repeat(F.lit(" "), F.lit(1000)))).otherwise(line)
        lines = _contacts(spark, sf_dir).select("id", line.alias("line"))
        lines.repartition(5, "id").write.parquet(path)
        checks = {"no JSON": F.try_parse_json("line").isNotNull(), "too long": F.octet_length("line") <= 1000}
        stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 2).parquet(path)
        change = lambda df: df.withColumn("line", tokenise.tokenise_json(F.col("line")))
        state.with_quarantine(stream, checks, change, target, aside, checkpoint).awaitTermination()
        good, bad = (spark.read.option("basePath", x).parquet(f"{x}/batch=*") for x in (target, aside))
        rows = good.select("id", F.lit(None).cast("string").alias("error")).union(bad.select("id", "error"))
        out = keep(scratch.written(rows, "stream-checked"))
        for folder in (path, target, aside, checkpoint):
            scratch.drop_path(spark, folder)
        return out
