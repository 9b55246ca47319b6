"""Spelling variants: words that differ by one inserted, deleted or replaced code point, without making pairs of words.

Two words of one length are near if they agree but for one place: each word goes to a group for every (place, text before, text
behind), and a group's size and its first two words tell all its members how many others there are and which is the most
frequent. A word with one code point more is near if one of its deletions is a word: deletions and words meet by their text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import numbered, small_batches, table, temporary, written

#: Code points and occurrences that a word needs, and how many times as often as a word its form must occur.
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: Keys of words up to so many code points are their texts; those of longer ones are 128-bit hashes, so that a word of n code
#: points has n keys of bounded size.
LITERAL = 64
#: Rows of keys of long words that a worker hands over at once.
KEY_ROWS = 1 << 14
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs_of(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_length: int = LEAST_LENGTH) -> DataFrame:
    """Rows (id, run): the maximal runs of Latin letters (A-Z, a-z, U+00C0 to U+00FF) with ``least_length`` code points or more
    in whole texts, A-Z lower-cased. Null texts have none."""
    runs = F.regexp_extract_all(F.translate(text_column, UPPER, LOWER), F.lit(r"[a-zÀ-ÿ]{%d,}" % least_length), F.lit(0))
    return docs.select(F.col(id_column).alias("id"), F.explode(runs).alias("run"))


def _replacements(word: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.length(word) - 1), lambda i: F.concat(F.lit("r"), i, F.lit(":"), F.substring(word, F.lit(1), i), F.substring(word, i + 2, F.length(word))))


def _deletions(word: Column) -> Column:
    every = F.transform(F.sequence(F.lit(0), F.length(word) - 1), lambda i: F.concat(F.lit("d:"), F.substring(word, F.lit(1), i), F.substring(word, i + 2, F.length(word))))
    return F.array_distinct(every)


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """64 well-mixed bits of each number."""
    x = x + np.uint64(salt)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def hashed_keys(word: str, literal: int) -> Iterator[tuple[str, int]]:
    """(key, kind) of a word longer than ``literal``: its replacements, its deletions (where these are longer, too) and itself.

    The hash of a text adds up 128 mixed bits of every (place, code point), so that what lacks one place is a difference of
    sums, and what has moved up by one place another sum: all keys take one pass.
    """
    points = np.array([ord(c) for c in word], np.uint64)
    places = np.arange(len(points), dtype=np.uint64)
    sums = []
    for salt in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03):
        here = _mixed(places << np.uint64(21) | points, salt)
        moved = _mixed((places - np.uint64(1)) << np.uint64(21) | points, salt)
        before = np.cumsum(here) - here
        total = before[-1] + here[-1]
        sums.append((total - here, before + np.cumsum(moved[::-1])[::-1] - moved, total))
    (replaced, deleted, total), (replaced2, deleted2, total2) = sums
    n = len(points)
    for i in range(n):
        yield f"R{n}:{i}:{replaced[i]:016x}{replaced2[i]:016x}", 0
    if n - 1 > literal:
        for i in np.flatnonzero(np.r_[True, points[1:] != points[:-1]]):  # one of each run of equal ones
            yield f"D{n - 1}:{deleted[i]:016x}{deleted2[i]:016x}", 1
    yield f"D{n}:{total:016x}{total2:016x}", 2


def _keys(words: DataFrame) -> DataFrame:
    """Rows (key, kind, rank) of words (word, rank): kind 0 replacements, 1 deletions, 2 the word itself."""
    length, word, literal = F.length("word"), F.col("word"), LITERAL
    short = words.where(length <= literal)
    rows = [
        short.select(F.explode(_replacements(word)).alias("key"), F.lit(0).alias("kind"), "rank"),
        words.where(length <= literal + 1).select(F.explode(_deletions(word)).alias("key"), F.lit(1).alias("kind"), "rank"),
        short.select(F.concat(F.lit("d:"), word).alias("key"), F.lit(2).alias("kind"), "rank"),
    ]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for word, rank in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = hashed_keys(word, literal)
                while part := list(islice(found, KEY_ROWS)):
                    keys, kinds = zip(*part)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(kinds, pa.int32()), pa.array([rank] * len(part), pa.int64())], names=["key", "kind", "rank"])

    rows.append(words.where(length > literal).select("word", "rank").mapInArrow(run, "key string, kind int, rank long"))
    out = rows[0]
    for other in rows[1:]:
        out = out.union(other)
    return out


def variants(counts: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n) of distinct words (word, n).

    ``n_near`` counts the words that differ from a word by one code point; ``form`` is the most frequent of them (of equal ones
    the smallest in code-point order), if it occurs ``ratio`` times as often as the word or more, and ``form_n`` its n;
    ``root`` is where forms of forms end, the word itself without a form.

    Words get their rank by n and text, so that the smallest rank is the best word and groups hold numbers alone. A group has
    a member for each code point that may stand at its place, a key of deletions one for each place and code point.
    Rows with a null or empty word or a null n are left out; other columns are ignored; an empty table gives an empty result.
    """
    small_batches(counts.sparkSession)
    with temporary() as keep:
        known = written(counts.select("word", F.col("n").cast("long").alias("n")).where("word <> '' AND n IS NOT NULL"), "words")
        ranked = numbered(known.repartitionByRange(F.desc("n"), "word").sortWithinPartitions(F.desc("n"), "word"), "ranks")
        words = written(ranked.select("word", "n", F.col("id").alias("rank")), "ranked-words")
        group = Window.partitionBy("key").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        grouped = _keys(words).select(
            "kind",
            "rank",
            F.count("*").over(group).alias("size"),
            F.first("rank").over(group).alias("first"),
            F.nth_value("rank", 2).over(group).alias("second"),
            F.max(F.when(F.col("kind") == 2, F.col("rank"))).over(group).alias("itself"),
        )
        others = F.col("size") - 1
        best = F.when(F.col("rank") == F.col("first"), F.col("second")).otherwise(F.col("first"))
        of_deletion = F.col("kind") == 1  # near is the word that the deletion gives, if there is one
        near = F.when(of_deletion, F.col("itself").isNotNull().cast("long")).otherwise(others)
        each = grouped.select("rank", near.alias("near"), F.when(of_deletion, F.col("itself")).otherwise(best).alias("best")).where("near > 0")
        summed = each.groupBy("rank").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
        forms = words.select(F.col("rank").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
        found = words.join(summed, "rank", "left").join(forms, "best", "left")
        holds = F.col("form_n") >= ratio * F.col("n")
        told = lambda name: F.when(holds, F.col(name)).alias(name)
        found = written(found.select("rank", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), told("best"), told("form"), told("form_n")), "forms")
        roots = _roots(found.where("best IS NOT NULL").select("rank", F.col("best").alias("root")))
        named = roots.join(words.select(F.col("rank").alias("root"), F.col("word").alias("root_word")), "root").select("rank", "root_word")
        out = found.join(named, "rank", "left")
        return keep(written(out.select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n"), "variants"))


def _roots(pointers: DataFrame) -> DataFrame:
    """Where pointers (rank, root) end, each doubled until none goes on; roots are always smaller, so there are no circles."""
    now = written(pointers, "roots")
    while True:
        beyond = now.select(F.col("rank").alias("root"), F.col("root").alias("further"))
        after = written(now.join(beyond, "root", "left").select("rank", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        moved = after.where("moved").limit(1).count()
        now = after.select("rank", "root")
        if not moved:
            return now


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spelling variants among the words of the documents, of which one in 199 of a document's loses a letter."""
    runs = runs_of(table(spark, sf_dir, "documents"))
    mark = F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = (F.col("mark") % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = runs.withColumn("mark", mark).select(F.when(F.col("mark") % 199 == 0, less).otherwise(F.col("run")).alias("word"))
    counts = words.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n"))
    return variants(counts.where(F.col("n") >= LEAST_COUNT))


def _crc_table() -> list[int]:
    """What each byte does to a CRC-32 (reflected polynomial EDB88320)."""
    out = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
        out.append(byte)
    return out


OP11_SQL = rf"""
WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS many, list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda c: unicode(c)) AS points
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY 1, 2
), bytes AS (
  SELECT run, many, flatten(list_transform(points, lambda u: CASE WHEN u < 128 THEN [u] ELSE [192 | (u >> 6), 128 | (u & 63)] END)) AS b FROM runs
), marked AS (
  SELECT run, many, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(b, lambda x: x::BIGINT)),
         lambda c, x: xor(({_crc_table()}::BIGINT[])[xor(c, x) % 256 + 1], c >> 8))) AS h FROM bytes
), words AS (
  SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, many FROM marked
), vocabulary AS MATERIALIZED (
  SELECT word, sum(many)::BIGINT AS n, length(word) AS size FROM words WHERE length(word) >= 6 GROUP BY word HAVING sum(many) >= 5
), places AS MATERIALIZED (
  SELECT word, size, i, left(word, i::INT) || substr(word, i::INT + 2) AS rest FROM (SELECT word, size, unnest(range(0, size)) AS i FROM vocabulary)
), near AS MATERIALIZED (
  SELECT a.word, b.word AS other FROM places a JOIN places b ON a.size = b.size AND a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT p.word, v.word FROM places p JOIN vocabulary v ON v.word = p.rest
  UNION SELECT v.word, p.word FROM places p JOIN vocabulary v ON v.word = p.rest
), counted AS (
  SELECT x.word, count(*) AS n_near, min({{'minus': -v.n, 'other': x.other}}) AS best FROM near x JOIN vocabulary v ON v.word = x.other GROUP BY 1
), formed AS MATERIALIZED (
  SELECT v.word, v.n, coalesce(c.n_near, 0) AS n_near, CASE WHEN -c.best.minus >= 5 * v.n THEN c.best.other END AS form,
         CASE WHEN -c.best.minus >= 5 * v.n THEN -c.best.minus END AS form_n
  FROM vocabulary v LEFT JOIN counted c ON c.word = v.word
), chains AS (
  SELECT word, form AS at FROM formed WHERE form IS NOT NULL
  UNION ALL SELECT c.word, f.form FROM chains c JOIN formed f ON f.word = c.at WHERE f.form IS NOT NULL
), ends AS (
  SELECT c.word, c.at AS root FROM chains c JOIN formed f ON f.word = c.at WHERE f.form IS NULL
)
SELECT f.word, f.form, coalesce(e.root, f.word) AS root, f.n, f.n_near, f.form_n FROM formed f LEFT JOIN ends e ON e.word = f.word
"""
