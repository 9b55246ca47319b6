"""Phrase collocations: words that occur often get ids, other words break pieces, and n-grams of ids are packed into keys of fixed
width that are range-partitioned, radix-sorted and counted by run length."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_broadcast, numbered, small_batches, table, temporary, utf8, written

#: Occurrences that a phrase needs, words that it has at most, and how many phrases of a language are reported.
LEAST, MOST_WORDS, TOP = 30, 4, 2000
#: A phrase is dropped if a longer one that holds it has at least so many hundredths of its occurrences.
INSIDE = 80
#: Bytes of text that are encoded together. Only a piece without any separator may be longer than that.
CHUNK_BYTES = 3 << 20
#: Frequent words or n-grams that are broadcast at once; more of them are joined by shuffle.
BROADCAST_GRAMS = 1 << 19
#: Rows that Python workers get at once where rows are a few numbers.
NARROW_ROWS = 1 << 16

# Lower case, every separator of pieces a line feed, every separator of words a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
#: Stands for the end of a piece; no UTF-8 text holds this byte.
_BREAK = b"\xff"
_CODES = "chunk long, lang string, codes binary"


@contextmanager
def narrow_rows(spark: SparkSession) -> Iterator[None]:
    """Within this scope workers get many rows at once; what runs in it must have rows of a few numbers."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(NARROW_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _slices(data: bytes) -> Iterator[bytes]:
    """``data`` cut behind line feeds into slices of about ``CHUNK_BYTES``."""
    at = 0
    while at < len(data):
        end = len(data)
        if end - at > CHUNK_BYTES:
            end = data.rfind(b"\n", at, at + CHUNK_BYTES) + 1 or data.find(b"\n", at + CHUNK_BYTES) + 1 or len(data)
        yield data[at:end]
        at = end


def _chunks(docs: DataFrame) -> DataFrame:
    """Rows (chunk, lang, codes, words, many): texts (lang, text) of a language cut into chunks, each with the distinct words in
    it, how many times each occurs, and the words' numbers (from 1, within the chunk) in order, with 0 at the end of each piece."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 33

        def encoded(lang: str, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
            nonlocal made
            for part in _slices(b"\n".join(texts)):
                tokens = part.replace(b"\n", b" \xff ").split()
                number = {_BREAK: 0}
                for token in tokens:
                    number.setdefault(token, len(number))
                codes = np.fromiter(map(number.__getitem__, tokens), "<i4", len(tokens))
                many = np.bincount(codes, minlength=len(number))[1:].astype(np.int32)
                words = pa.array(list(number)[1:], pa.binary()).cast(pa.string())
                columns = [pa.array([made]), pa.array([lang]), pa.array([codes.tobytes()], pa.binary()), _listed(words), _listed(pa.array(many))]
                yield pa.RecordBatch.from_arrays(columns, names=["chunk", "lang", "codes", "words", "many"])
                made += 1

        held: dict[str, list[bytes]] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(lang, []).append(text.translate(_FOLD))
                size += len(text)
            if size >= CHUNK_BYTES:
                for lang, texts in held.items():
                    yield from encoded(lang, texts)
                held, size = {}, 0
        for lang, texts in held.items():
            yield from encoded(lang, texts)

    return docs.mapInArrow(run, f"{_CODES}, words array<string>, many array<int>")


def _listed(values: pa.Array) -> pa.Array:
    """One row that holds all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _longer(chunks: DataFrame) -> DataFrame:
    """Rows (chunk, lang, codes, keys, highs, many): n-grams of one more word, from rows (chunk, lang, codes, known).

    ``known`` holds (j, id) of those numbers in ``codes`` that are frequent. Where two stand at neighbouring places, their ids
    are packed into a key of 80 bits: ``keys`` has the low 32 bits of both, ``highs`` the next 8 bits of both. The new codes
    number the packed keys.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                chunk, lang, raw, known = (c.slice(row, 1) for c in batch.columns)
                codes = np.frombuffer(raw[0].as_buffer(), "<i4")
                pairs = known.flatten()
                j, ids = (pairs.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                local = np.zeros(max(int(codes.max(initial=0)), int(j.max(initial=0))) + 1, np.int64)
                local[j] = np.arange(1, len(j) + 1)
                at = local[codes]
                here = np.flatnonzero((at[:-1] > 0) & (at[1:] > 0))
                packed, number, many = np.unique((at[here] - 1) * len(j) + at[here + 1] - 1, return_inverse=True, return_counts=True)
                first, second = (ids[x] for x in np.divmod(packed, max(len(j), 1)))
                longer = np.zeros(len(codes), "<i4")
                longer[here] = number.reshape(-1) + 1
                keys = ((first & 0xFFFFFFFF) << 32) | (second & 0xFFFFFFFF)
                highs = ((first >> 32) << 8 | (second >> 32)).astype(np.int32)
                lists = [_listed(pa.array(x)) for x in (keys, highs, many.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([chunk, lang, pa.array([longer.tobytes()], pa.binary()), *lists], names=["chunk", "lang", "codes", "keys", "highs", "many"])

    return chunks.select("chunk", "lang", "codes", "known").mapInArrow(run, f"{_CODES}, keys array<long>, highs array<int>, many array<int>")


def _run_lengths(rows: DataFrame, least: int) -> DataFrame:
    """Rows (key, high, a): how many each key has in all, of rows (key, high, many), for those with ``least`` or more.

    Rows are range-partitioned and sorted by the key (one long column, for which Spark's sort is a radix sort that spills).
    Keys that differ in ``high`` alone are told apart as the runs are added up; a run that goes on in the next batch is carried
    along as one row.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = tuple(np.empty(0, np.int64) for _ in range(3))

        def frequent(columns: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c[columns[2] >= least]) for c in columns], names=["key", "high", "a"])

        for batch in batches:
            if not batch.num_rows:
                continue
            new = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
            key, high, many = (np.concatenate(x) for x in zip(held, new))
            if high.any():
                order = np.lexsort((high, key))
                key, high, many = key[order], high[order], many[order]
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (high[1:] != high[:-1])])
            columns = key[starts], high[starts], np.add.reduceat(many, starts)
            done = columns[0] != key[-1]
            held = tuple(c[~done] for c in columns)
            yield frequent(tuple(c[done] for c in columns))
        yield frequent(held)

    return rows.select("key", "high", "many").repartitionByRange("key").sortWithinPartitions("key").mapInArrow(run, "key long, high long, a long")


def _known(chunks: DataFrame, rows: DataFrame, frequent: DataFrame, key: list[str]) -> DataFrame:
    """``chunks`` with ``known``, the (j, id) of those of their ``rows`` (chunk, j, *key) that are among ``frequent``."""
    met = rows.join(bounded_broadcast(frequent.select(*key, "id"), BROADCAST_GRAMS), key)
    lists = met.groupBy("chunk").agg(F.collect_list(F.struct(F.col("j").cast("long").alias("j"), "id")).alias("known"))
    return chunks.select("chunk", "lang", "codes").join(lists, "chunk")


def _half(first: bool) -> Column:
    """One of the two ids that a key packs."""
    low, high = (F.shiftrightunsigned("key", 32), F.shiftright("high", 8)) if first else (F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)), F.col("high").bitwiseAND(F.lit(0xFF)))
    return F.shiftleft(high.cast("long"), 32).bitwiseOR(low)


#: Of all cuts of a phrase of m words the one with the lowest score, then with the fewest words before it.
_CUT = """
array_min(transform(sequence(1, m - 1), k -> named_struct(
  'score', CAST(2000000 AS DECIMAL(19,0)) * CAST(a AS DECIMAL(19,0)) div CAST(element_at(pre, k) + element_at(suf, m - k) AS DECIMAL(19,0)),
  'k', k, 'l', element_at(pre, k), 'r', element_at(suf, m - k))))
"""


def collocations(docs: DataFrame, lang_column: str = "lang", text_column: str = "text", least: int = LEAST, most_words: int = MOST_WORDS) -> tuple[DataFrame, DataFrame]:
    """Rows (lang, m, phrase, a, l, r, score) of all phrases that stay, and rows (lang, n) with each language's words.

    Texts are lower-cased (A-Z) and cut at ``.,;:!?`` and line ends into pieces, those at blanks and tabs into words. A phrase has
    two to ``most_words`` words and occurs ``a`` >= ``least`` times within pieces. Cut in two after its first k words, with
    ``l`` and ``r`` occurrences of the parts, it scores floor(2000000 a / (l + r)); the lowest score counts, of equal ones the
    smallest k's. Phrases are dropped that stand in a longer phrase with at least 80 hundredths of their occurrences.

    Texts are encoded in chunks, with numbers of their own. The chunks' words are added up; those that occur ``least`` times
    get an id, which goes back to the chunks that have the word. N-grams then grow by a word at a time: a key packs the ids of
    the two frequent n-grams of a word less that it consists of, so that no n-gram is counted that cannot be frequent, and
    none that can is lost. A frequent word or n-gram has one row in each chunk at most, however often it is repeated.

    Null languages read as ``und``, null texts as empty; empty texts have no words; repeated rows and equal ids all count;
    other columns are ignored; an empty table gives empty results.
    """
    spark = docs.sparkSession
    small_batches(spark)
    lang = F.coalesce(F.col(lang_column), F.lit("und")).cast("string")
    with temporary() as keep:
        chunks = written(_chunks(docs.select(lang.alias("lang"), utf8(text_column).alias("text"))), "chunks")
        totals = chunks.groupBy("lang").agg(F.sum(F.aggregate("many", F.lit(0).cast("long"), lambda n, x: n + x)).alias("n"))
        totals = keep(written(totals, "totals"))
        words = chunks.select("chunk", "lang", F.posexplode(F.arrays_zip("words", "many")).alias("j", "x"))
        words = words.select("chunk", "lang", (F.col("j") + 1).alias("j"), F.col("x.words").alias("word"), F.col("x.many").alias("many"))
        counted = words.groupBy("lang", "word").agg(F.sum("many").alias("a")).where(F.col("a") >= least)
        frequent = numbered(counted, "words")
        one = F.array("a")
        full = [frequent.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "a", one.alias("pre"), one.alias("suf"))]
        halves = []
        rows, key = words, ["lang", "word"]
        for size in range(2, most_words + 1):
            known = _known(chunks, rows, frequent, key)
            chunks = written(_longer(known), f"grams-{size}")
            rows = chunks.select("chunk", F.posexplode(F.arrays_zip("keys", "highs", "many")).alias("j", "x"))
            rows = rows.select("chunk", (F.col("j") + 1).alias("j"), F.col("x.keys").alias("key"), F.col("x.highs").cast("long").alias("high"), F.col("x.many").alias("many"))
            key = ["key", "high"]
            with narrow_rows(spark):
                frequent = numbered(_run_lengths(rows, least), f"frequent-{size}")
            halves.append(frequent.select("id", "a", _half(True).alias("left"), _half(False).alias("right")))
            full.append(written(_spelt(halves[-1], full[-1]), f"spelt-{size}"))
        kept = None
        for m, phrases in enumerate(full[1:], 2):
            out = phrases
            if m < most_words:
                longer = halves[m - 1].select(F.explode(F.array("left", "right")).alias("id"), F.col("a").alias("more"))
                out = out.join(longer.groupBy("id").agg(F.max("more").alias("more")), "id", "left").where(F.expr(f"more IS NULL OR 100 * more < {INSIDE} * a"))
            cut = out.withColumn("m", F.lit(m)).withColumn("cut", F.expr(_CUT))
            cut = cut.select("lang", "m", "phrase", "a", "cut.l", "cut.r", "cut.score")
            kept = cut if kept is None else kept.union(cut)
        return keep(written(kept, "phrases")), totals


def _spelt(grams: DataFrame, shorter: DataFrame) -> DataFrame:
    """Rows (id, lang, phrase, last, a, pre, suf) of n-grams (id, a, left, right) of two of ``shorter``: the words in full, and how
    often the phrase's first and last words occur, by how many they are."""
    left = shorter.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("start"), F.col("pre").alias("before"))
    right = shorter.select(F.col("id").alias("right"), "last", F.col("suf").alias("behind"))
    rows = grams.join(left, "left").join(right, "right")
    more = lambda name: F.concat(name, F.array("a"))
    return rows.select("id", "lang", F.concat_ws(" ", "start", "last").alias("phrase"), "last", "a", more("before").alias("pre"), more("behind").alias("suf"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of each language, ranked."""
    with temporary() as keep:
        phrases, totals = collocations(table(spark, sf_dir, "documents"))
        order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        ranked = phrases.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
        out = ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
        return keep(written(out, "top-phrases"))


OP12_SQL = r"""
WITH docs AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM docs)
), starts AS (
  SELECT lang, w, len(w) AS size, unnest(range(1, len(w) + 1)) AS i FROM pieces
), grams AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM starts, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE i + m - 1 <= size
), f AS (
  SELECT lang, m, phrase, count(*) AS a FROM grams GROUP BY 1, 2, 3
), totals AS (
  SELECT lang, sum(a)::BIGINT AS n FROM f WHERE m = 1 GROUP BY 1
), candidates AS (
  SELECT lang, m, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE m >= 2 AND a >= 30
), parts AS (
  SELECT lang, m, phrase, a, k, array_to_string(w[1:k], ' ') AS first_part, array_to_string(w[k + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates)
), scored AS (
  SELECT p.lang, p.phrase, p.a, p.k, x.a AS l, y.a AS r, CAST((2000000::HUGEINT * p.a) // (x.a + y.a) AS BIGINT) AS score
  FROM parts p JOIN f x ON x.lang = p.lang AND x.phrase = p.first_part JOIN f y ON y.lang = p.lang AND y.phrase = p.rest
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(a) AS more
  FROM (SELECT lang, m, w, a, s, unnest(range(1, m - s + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS s FROM candidates)) GROUP BY 1, 2
)
SELECT c.lang, row_number() OVER (PARTITION BY c.lang ORDER BY c.score DESC, c.a DESC, c.phrase) AS rank, c.phrase, c.a, c.l, c.r, t.n, c.score
FROM lowest c JOIN totals t ON t.lang = c.lang LEFT JOIN inside i ON i.lang = c.lang AND i.phrase = c.phrase
WHERE i.more IS NULL OR 100 * i.more < 80 * c.a
QUALIFY row_number() OVER (PARTITION BY c.lang ORDER BY c.score DESC, c.a DESC, c.phrase) <= 2000
"""
