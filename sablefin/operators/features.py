"""Features of columns: lengths, character classes, entropies, n-grams; and what kind of column they make."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sablefin.errors import ColumnError, ModelError
from sablefin.sources.scratch import written
from sablefin.sources.tables import spread
from sablefin.sources.workers import reach_package

HEADER_SIZE, HASH_SIZE = 300, 64

# Words in a column's name that point to prose, and how much each kind of column counts.
NAME_HINTS = ["description", "comment", "feedback", "review", "notes", "text"]
TYPE_WEIGHTS = {"TextLong": 1.0, "TextShort": 0.8, "Categorical": 0.6}
OTHER_WEIGHT = 0.1
#: What counts as a number: an optional sign, digits with an optional point, an exponent; or inf, infinity or nan.
NUMBER = r"^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|[iI][nN][fF](?:[iI][nN][iI][tT][yY])?|[nN][aA][nN])$"


def length_stats(df: DataFrame) -> DataFrame:
    """Rows (column_name, mean, least, most, deviation) of byte lengths, from rows (column_name, value)."""
    size = F.octet_length("value")
    return df.groupBy("column_name").agg(
        F.round(F.avg(size), 6).alias("mean_length"), F.min(size).alias("min_length"), F.max(size).alias("max_length"), F.round(F.stddev_pop(size), 6).alias("std_length")
    )


def class_ratios(df: DataFrame) -> DataFrame:
    """Rows (column_name, digits, letters, blanks, special): shares of all characters."""
    sums = [F.sum(F.regexp_count("value", F.lit(r))).alias(n) for n, r in (("d", "[0-9]"), ("a", r"\p{L}"), ("w", r"\s"))]
    once = df.groupBy("column_name").agg(*sums, F.sum(F.length("value")).alias("n"))
    share = lambda c: F.round(F.coalesce(F.try_divide(c, F.col("n")), F.lit(0.0)), 6)
    rest = F.col("n") - F.col("d") - F.col("a") - F.col("w")
    return once.select("column_name", share(F.col("d")).alias("digits"), share(F.col("a")).alias("letters"), share(F.col("w")).alias("blanks"), share(rest).alias("special"))


def characters(text: Column) -> Column:
    """A text's characters, in one pass."""
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def _on_end(parts: Column, n: int, between: str = "") -> Column:
    """All n elements on end, joined; none in shorter arrays.

    The array is laid beside itself, one further each time: a lambda that sliced it would compute it again for each element.
    """
    out = parts
    for i in range(1, n):
        out = F.zip_with(out, F.slice(parts, i + 1, F.greatest(F.size(parts), F.lit(1))), lambda a, b: F.concat(a, F.lit(between), b))
    return F.slice(out, 1, F.greatest(F.size(parts) - (n - 1), F.lit(0)))


def char_ngrams(text: Column, n: int) -> Column:
    """All n characters on end; none in shorter texts."""
    return _on_end(characters(text), n)


def token_ngrams(text: Column, n: int) -> Column:
    """All n words on end, joined by blanks; none in shorter texts."""
    return _on_end(F.array_remove(F.split(text, r"\s+"), ""), n, " ")


def ngram_kinds(df: DataFrame, key: str, text_column: str, n: int) -> DataFrame:
    """Rows (key, n, kinds, first): how many n words on end a key's texts have, how many different ones, and the least of them.

    A key of one row has its n-grams counted where the row is; only keys that repeat (and the null one) send theirs through a
    shuffle. Keys are counted first.
    """
    rows = df.select(key, text_column)
    again = rows.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").select(key)
    again = written(again, "repeated-keys")
    repeated = again.limit(1).count() > 0
    texts = spread(rows)
    alone = texts.where(F.col(key).isNotNull())
    alone = alone.join(again, key, "left_anti") if repeated else alone
    told = F.transform(
        F.array(token_ngrams(F.col(text_column), n)), lambda g: F.struct(F.size(g).cast("long").alias("n"), F.size(F.array_distinct(g)).cast("long").alias("kinds"), F.array_min(g).alias("first"))
    )
    found = alone.select(key, F.explode(F.filter(told, lambda t: t["first"].isNotNull())).alias("told")).select(key, "told.*")
    rest = texts.where(F.col(key).isNull())
    rest = rest.union(texts.join(again, key, "left_semi").select(key, text_column)) if repeated else rest
    each = rest.select(key, F.explode(token_ngrams(F.col(text_column), n)).alias("gram")).groupBy(key)
    return found.union(each.agg(F.count("*").alias("n"), F.count_distinct("gram").alias("kinds"), F.min("gram").alias("first")))


def ngram_counts(df: DataFrame, n: int) -> DataFrame:
    """Rows (column_name, gram, n) of how often each n characters stand in a column."""
    return df.select("column_name", F.explode(char_ngrams(F.col("value"), n)).alias("gram")).groupBy("column_name", "gram").agg(F.count("*").alias("n"))


#: What stands behind a text's last character.
_END = 0x110000
#: Kinds of pairs that are counted in a table rather than by sorting.
_PAIR_TABLE = 1 << 22
#: Bytes of texts whose pairs are counted at once, whatever a batch holds.
PAIR_BYTES = 1 << 20


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch cut into parts of about ``PAIR_BYTES`` bytes of its second column, of a row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(sizes) - sizes) // PAIR_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for low, high in zip(cuts, cuts[1:]):
        if high > low:
            yield batch.slice(low, high - low)


def _pieces(values: list[str | None]) -> tuple[list[list[str]], list[list[bool]]]:
    """Texts in groups of about ``PAIR_BYTES`` characters, and whether each goes on: a longer text is cut into pieces, each of which
    ends with the next one's first character."""
    groups, goes_on, room = [], [], 0
    for value in values:
        for at in range(0, len(value or ""), PAIR_BYTES):
            piece = value[at : at + PAIR_BYTES + 1]
            if room < len(piece):
                groups.append([])
                goes_on.append([])
                room = max(PAIR_BYTES, len(piece))
            groups[-1].append(piece)
            goes_on[-1].append(at + PAIR_BYTES < len(value))
            room -= len(piece)
    return groups, goes_on


def pair_counts(df: DataFrame) -> DataFrame:
    """Rows (column_name, a, b, n): how often each character (as a number) stands before each other one, which is null behind a
    text's last. So many bytes of a batch are counted before anything is handed on, so rows are no more than kinds of pairs, and a
    worker needs no more room for long texts than for short ones; a text that is longer is counted in pieces."""
    reach_package(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in _parts(batch)):
            table = pa.table({"name": part.column(0), "value": part.column(1)})
            for name in table.column("name").unique().to_pylist():
                own = table.filter(pc.equal(table.column("name"), name) if name is not None else pc.is_null(table.column("name")))
                values, more = _pieces(own.column("value").to_pylist())
                for at in range(len(values)):
                    yield counted(name, values[at], more[at])

    def counted(name: str | None, values: list[str], more: list[bool]) -> pa.RecordBatch:
        points = np.frombuffer("".join(values).encode("utf-32-le"), "<u4")
        kinds = np.append(np.flatnonzero(np.bincount(points)), _END)
        number = np.zeros(_END + 1, np.int32)
        number[kinds] = np.arange(len(kinds))
        first = number[points].astype(np.int64)
        second = np.append(first[1:], 0)
        ends = np.cumsum([len(v) for v in values]) - 1
        second[ends] = len(kinds) - 1
        pairs = np.delete(first * len(kinds) + second, ends[np.array(more)])  # the next piece has them
        if len(kinds) ** 2 <= _PAIR_TABLE:
            counts = np.bincount(pairs)
            found = np.flatnonzero(counts)
            many = counts[found]
        else:
            found, many = np.unique(pairs, return_counts=True)
        a, b = (kinds[x] for x in np.divmod(found, len(kinds)))
        columns = [pa.array([name] * len(found), pa.string()), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32), mask=b == _END), pa.array(many.astype(np.int64))]
        return pa.RecordBatch.from_arrays(columns, names=["column_name", "a", "b", "n"])

    each = df.select("column_name", F.col("value").cast("string").alias("value")).mapInArrow(run, "column_name string, a int, b int, n long")
    return each.groupBy("column_name", "a", "b").agg(F.sum("n").alias("n"))


def entropies(df: DataFrame) -> DataFrame:
    """Rows (column_name, entropy, normalised, rate, simpson).

    The entropy in bits of single characters; by the logarithm of how many there are, at most 1 (0 for one character); the
    entropy of two characters on end; and the chance that two characters drawn differ.
    """

    seen = pair_counts(df)

    def of(counts: DataFrame, name: str) -> DataFrame:
        total = counts.groupBy("column_name").agg(
            F.sum("n").alias("all"), F.sum(F.col("n") * F.log2("n")).alias("weighted"), F.count("*").alias("kinds"), F.sum(F.col("n").cast("double") * (F.col("n") - 1)).alias("pairs")
        )
        return total.select("column_name", (F.log2("all") - F.col("weighted") / F.col("all")).alias(name), F.col("kinds").alias(f"{name}_kinds"), F.col("all").alias(f"{name}_all"), F.col("pairs").alias(f"{name}_pairs"))

    single = seen.groupBy("column_name", "a").agg(F.sum("n").alias("n"))
    both = of(single, "entropy").join(of(seen.where("b IS NOT NULL"), "rate"), "column_name", "left")
    kinds, total = F.col("entropy_kinds"), F.col("entropy_all").cast("double")
    normal = F.when(kinds > 1, F.least(F.col("entropy") / F.log2(kinds), F.lit(1.0))).otherwise(F.lit(0.0))
    simpson = F.when(total > 1, 1 - F.col("entropy_pairs") / (total * (total - 1))).otherwise(F.lit(0.0))
    return both.select(
        "column_name", F.round("entropy", 6).alias("entropy"), F.round(normal, 6).alias("normalised"), F.round(F.coalesce("rate", F.lit(0.0)), 6).alias("rate"), F.round(simpson, 6).alias("simpson")
    )


def bucket(gram: Column, size: int = HASH_SIZE) -> Column:
    """The hash bucket of an n-gram."""
    return F.pmod(F.conv(F.substring(F.md5(gram), 1, 15), 16, 10).cast("long"), F.lit(size))


def hashed_ngrams(df: DataFrame, n: int = 3, size: int = HASH_SIZE) -> DataFrame:
    """Rows (column_name, bucket, share): hashed n-grams, of which a column's shares add up to 1."""
    counts = df.select("column_name", F.explode(char_ngrams(F.col("value"), n)).alias("gram")).groupBy("column_name", bucket(F.col("gram"), size).alias("bucket"))
    counts = counts.agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("column_name"))  # as many rows as buckets
    return counts.select("column_name", "bucket", F.round(F.col("n") / total, 6).alias("share"))


def header_indices(name: Column, size: int = HEADER_SIZE) -> Column:
    """The places that a column's name sets in its header vector: code point times position from 1, modulo the size."""
    codes = F.transform(characters(name), lambda c, i: (F.ascii(c) * (i + 1)) % size)
    return F.array_sort(F.array_distinct(codes))


def feature_vectors(df: DataFrame) -> DataFrame:
    """Rows (column_name, features): 300 of the name, 4 of lengths, 4 shares, 3 entropies, Simpson, 64 of hashed n-grams."""
    hashed = hashed_ngrams(df).groupBy("column_name").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "share"))).alias("shares"))
    joined = length_stats(df).join(class_ratios(df), "column_name").join(entropies(df), "column_name", "left").join(hashed, "column_name", "left")
    at = header_indices(F.col("column_name"))
    header = F.transform(F.sequence(F.lit(0), F.lit(HEADER_SIZE - 1)), lambda i: F.array_contains(at, i.cast("int")).cast("double"))
    tail = F.transform(F.sequence(F.lit(0), F.lit(HASH_SIZE - 1)), lambda i: F.coalesce(F.col("shares")[i.cast("long")], F.lit(0.0)))
    names = ["mean_length", "min_length", "max_length", "std_length", "digits", "letters", "blanks", "special", "entropy", "normalised", "rate", "simpson"]
    middle = F.array(*(F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names))
    return joined.select("column_name", F.concat(header, middle, tail).alias("features"))


def api_features(df: DataFrame) -> DataFrame:
    """Rows (column_name, text_length_avg, text_length_std, word_count_avg, unique_ratio, rows)."""
    words = F.size(F.array_remove(F.split(F.col("value"), r"\s+"), ""))
    distinct = df.groupBy("column_name", "value").agg(F.count("*").alias("n"))
    length = F.length("value")
    weighted = distinct.groupBy("column_name").agg(
        F.sum(F.col("n") * length).alias("chars"), F.sum(F.col("n") * length.cast("double") * length).alias("squares"), F.sum(F.col("n") * words).alias("words"), F.sum("n").alias("rows"), F.count("*").alias("distinct")
    )
    mean = F.col("chars") / F.col("rows")
    spread = F.sqrt(F.greatest(F.col("squares") / F.col("rows") - mean * mean, F.lit(0.0)))
    return weighted.select(
        "column_name", F.round(mean, 6).alias("text_length_avg"), F.round(spread, 4).alias("text_length_std"), F.round(F.col("words") / F.col("rows"), 6).alias("word_count_avg"), F.round(F.col("distinct") / F.col("rows"), 6).alias("unique_ratio"), "rows"
    )


def classify(df: DataFrame) -> DataFrame:
    """Rows (column_name, column_type, confidence): Numeric if over 0.9 of the values are numbers; TextLong if values are
    over 15 bytes on average and under 0.1 are numbers; otherwise Unknown."""
    once = df.groupBy("column_name").agg(F.avg(F.coalesce(F.col("value").rlike(NUMBER), F.lit(False)).cast("int")).alias("numeric"), F.avg(F.coalesce(F.octet_length("value"), F.lit(0))).alias("bytes"))
    numeric, prose = F.col("numeric") > 0.9, (F.col("bytes") > 15) & (F.col("numeric") < 0.1)
    kind = F.when(numeric, "Numeric").when(prose, "TextLong").otherwise("Unknown")
    sure = F.when(numeric, F.col("numeric")).when(prose, F.lit(0.9)).otherwise(F.lit(0.5))
    return once.select("column_name", kind.alias("column_type"), F.round(sure, 6).alias("confidence"))


def classify_by_model(df: DataFrame, model: Callable[[list[list[float]]], list[list[float]]], kinds: list[str]) -> DataFrame:
    """Rows (column_name, column_type, confidence) by a model that gives each feature vector the probabilities of ``kinds``.

    The most likely kind counts, the first one of equals. Where the model fails, or gives no probability for each kind, the
    rules of :func:`classify` decide. Columns are few: a task hands all vectors of its rows to the model at once.
    """
    reach_package(df.sparkSession)

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            try:
                found = [list(map(float, row)) for row in model([list(x) for x in frame["features"]])] if len(frame) else []
                if len(found) != len(frame) or any(len(row) != len(kinds) for row in found):
                    raise ModelError("a probability for each kind is needed")
                best = [max(range(len(kinds)), key=lambda i: row[i]) for row in found]
                yield pd.DataFrame({"column_name": frame["column_name"], "model_type": [kinds[i] for i in best], "sure": [row[i] for row, i in zip(found, best)]})
            except Exception:  # whatever a model raises
                yield pd.DataFrame({"column_name": frame["column_name"], "model_type": None, "sure": None})

    by_model = feature_vectors(df).mapInPandas(run, "column_name string, model_type string, sure double")
    joined = classify(df).join(by_model, "column_name", "left")
    return joined.select("column_name", F.coalesce("model_type", "column_type").alias("column_type"), F.round(F.coalesce("sure", "confidence"), 6).alias("confidence"))


def type_scores(classified: DataFrame) -> DataFrame:
    """``classified`` with ``ml_score``: the confidence, weighted by the kind."""
    weights = F.create_map(*(F.lit(x) for item in TYPE_WEIGHTS.items() for x in item))
    return classified.withColumn("ml_score", F.round(F.col("confidence") * F.coalesce(weights[F.col("column_type")], F.lit(OTHER_WEIGHT)), 6))


def hinted(name: Column) -> Column:
    """Whether a name has one of the hints, as written."""
    return name.rlike("|".join(NAME_HINTS))


def profile(df: DataFrame, ml_only: bool = False, graph_only: bool = False) -> DataFrame:
    """Rows (name, score, ml_probability, graph_score, column_type), the best column first."""
    graph = F.lit(0.0) if ml_only else F.when(hinted(F.col("column_name")), 0.8).otherwise(0.2)
    score = F.col("confidence") if ml_only else graph if graph_only else (F.col("confidence") + graph) / 2
    found = classify(df).select(F.col("column_name").alias("name"), F.round(score, 6).alias("score"), F.col("confidence").alias("ml_probability"), graph.alias("graph_score"), "column_type")
    return found.orderBy(F.desc("score"), "name")


def auto_discover(columns: list[str]) -> list[str]:
    """The columns whose names have a hint."""
    return [c for c in columns if any(hint in c for hint in NAME_HINTS)]


def require_columns(df: DataFrame, columns: list[str]) -> None:
    """Raise :class:`ColumnError`, a KeyError, for columns that are not there."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ColumnError(f"no such columns: {', '.join(missing)}")
