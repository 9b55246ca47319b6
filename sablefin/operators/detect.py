"""Detection: where regexes find personal data, per source, per column, with confidence and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sablefin.functions.patterns import LIBRARY, NECESSARY, PATTERN_TYPES
from sablefin.sources.tables import long_form

THRESHOLD = 0.1
SAMPLE_ROWS, SAMPLES = 10_000, 10


def match_count(text: Column, regexes: list[str]) -> Column:
    """How often a kind's regexes match, added up; null for a null text."""
    total = F.when(text.isNotNull(), F.lit(0).cast("long"))
    for regex in regexes:
        count = F.regexp_count(text, F.lit(regex))
        total = total + (F.when(text.rlike(NECESSARY[regex]), count).otherwise(0) if regex in NECESSARY else count)
    return total


def all_matches(text: Column, regexes: list[str]) -> Column:
    """What a kind's regexes match, one regex after another."""
    return F.concat(*(F.regexp_extract_all(text, F.lit(r), F.lit(0)) for r in regexes))


def count_by_type(df: DataFrame, text: Column, library: dict[str, list[str]] = LIBRARY) -> DataFrame:
    """Rows (pattern_type, matches, scanned): all regexes run in one scan, whose one row is then turned."""
    sums = [F.coalesce(F.sum(match_count(text, r)), F.lit(0)).alias(t) for t, r in library.items()]
    once = df.agg(*sums, F.count("*").alias("scanned"))
    turned = F.array(*(F.struct(F.lit(t).alias("pattern_type"), F.col(t).alias("matches")) for t in library))
    return once.select("scanned", F.explode(turned).alias("x")).select("x.*", "scanned")


def detect_source(df: DataFrame, key: str, sample_rows: int = SAMPLE_ROWS, library: dict[str, list[str]] = LIBRARY) -> DataFrame:
    """Rows (pattern_type, matches, confidence) for records as JSON text, names included.

    The sample is the ``sample_rows`` rows with the smallest keys; confidence is matches by rows, 0 without rows.
    """
    sample = df.orderBy(key).limit(sample_rows).select(F.to_json(F.struct(*df.columns)).alias("json"))
    # A limit ends in one task; the regexes are dealt to all cores.
    found = count_by_type(sample.repartition(df.sparkSession.sparkContext.defaultParallelism), F.col("json"), library)
    confidence = F.coalesce(F.try_divide("matches", "scanned"), F.lit(0.0))
    return found.select("pattern_type", "matches", F.round(confidence, 6).alias("confidence"))


def recommend(detected: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Kinds at or above the threshold, the surest first, with a text for people."""
    kept = detected.where(F.col("confidence") >= threshold)
    text = F.format_string("Found %d matches with confidence %.2f", F.col("matches"), F.col("confidence"))
    place = Window.orderBy(F.desc("confidence"), "pattern_type")  # a row for each kind at most
    return kept.withColumn("rank", F.row_number().over(place)).withColumn("reason", text)


def detect_columns(df: DataFrame, columns: list[str], library: dict[str, list[str]] = LIBRARY) -> DataFrame:
    """Rows (column_name, pattern_type, matches, rows, confidence) of kinds that a column's values match.

    One scan counts every kind in every column; only the sums are turned into rows.
    """
    sums = [F.sum(match_count(F.col(c).cast("string"), r)).alias(f"{c}|{t}") for c in columns for t, r in library.items()]
    once = df.agg(*sums, F.count("*").alias("rows"))
    turned = F.array(
        *(F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("pattern_type"), F.col(f"`{c}|{t}`").alias("matches")) for c in columns for t in library)
    )
    found = once.select("rows", F.explode(turned).alias("x")).select("x.*", "rows").where("matches > 0")
    return found.withColumn("confidence", F.round(F.col("matches") / F.col("rows"), 6))


def column_patterns(detected: DataFrame) -> DataFrame:
    """Rows (column_name, pattern_types): the kinds found in each column, sorted and joined."""
    return detected.groupBy("column_name").agg(F.array_join(F.sort_array(F.collect_set("pattern_type")), ",").alias("pattern_types"))


def sample_matches(df: DataFrame, id_column: str, columns: list[str], library: dict[str, list[str]] = LIBRARY, most: int = SAMPLES) -> DataFrame:
    """Rows (pattern_type, sample, place): of each kind the ``most`` smallest distinct matches.

    Matches are made distinct before they are ranked, so a frequent one is no more rows than a rare one.
    """
    found = F.explode(F.array(*(F.struct(F.lit(t).alias("pattern_type"), all_matches(F.col("value"), r).alias("m")) for t, r in library.items())))
    each = long_form(df, id_column, columns).select(found.alias("x")).select("x.pattern_type", F.explode("x.m").alias("sample")).distinct()
    place = F.row_number().over(Window.partitionBy("pattern_type").orderBy("sample"))
    return each.withColumn("place", place).where(F.col("place") <= most)


def confidence(per_type: DataFrame, rows: Column, columns: Column) -> DataFrame:
    """One row of what a detection is worth: up to 0.5 for matches by row, 0.3 for kinds and 0.2 for columns found."""
    once = per_type.agg(F.sum("matches").alias("matches"), F.sum((F.col("matches") > 0).cast("int")).alias("kinds"), F.max(rows).alias("rows"), F.max(columns).alias("columns"))
    share = F.when(F.col("kinds") > 0, F.least(F.coalesce(F.try_divide(F.col("matches") * 100, F.col("rows")), F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
    score = 0.5 * share + 0.3 * F.least(F.col("kinds") / len(PATTERN_TYPES), F.lit(1.0)) + 0.2 * F.least(F.col("columns") / 10, F.lit(1.0))
    return once.withColumn("confidence", F.round(F.least(score, F.lit(1.0)), 6))
