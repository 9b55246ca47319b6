"""A corpus pipeline of five stages, each calling one operator of this subpackage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. What a stage returns is written as Parquet and read again
as the next one's ``docs``; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, packing, simhash, substrings, toxicity
from .common import bounded_broadcast, drop_written, is_held_out, table, temporary, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject (score below 0.5).

    It learns from labelled documents that are not held out. A row goes by its id (null is an id, too) and its text, so other
    texts of an id stay and repeated rows go together; clean documents stay, labels or not. Null texts are scored as
    empty ones; without labels nothing goes; an empty table stays empty; other columns stay as they are.
    """
    model = toxicity.learn(docs, table(spark, sf_dir, "labels").where(~is_held_out(5, 0)))
    row = F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("text_hash"))
    with temporary() as keep:
        found = toxicity.classify(docs.select(row.alias("row"), "text"), model, id_column="row").where("predicted = 1")
        gone = keep(written(found.select(F.col("id.id").alias("__gone"), F.col("id.text_hash").alias("__text")).distinct(), "toxic"))
    same = docs["doc_id"].eqNullSafe(gone["__gone"]) & (F.xxhash64(docs["text"]) == gone["__text"])
    return docs.join(bounded_broadcast(gone), same, "left_anti")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group, the one with the smallest id; :func:`simhash.keep_first` says what becomes of nulls,
    repeated rows and repeated ids. All columns stay; an empty table stays empty."""
    return simhash.keep_first(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document has; those that consist of such passages go.

    :func:`substrings.remove_passages` says what becomes of nulls, repeated rows and repeated ids. All columns stay,
    ``n_chars`` is brought up to date; an empty table stays empty."""
    return substrings.remove_passages(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark; :func:`decontaminate.without_leaks` says what becomes of nulls, repeated
    rows and repeated ids. All columns stay; an empty table stays empty, and nothing goes if the benchmark is empty."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed token sequences. Null texts count as empty; rows that repeat an id, null included, are documents
    of their own; other columns are ignored; an empty table gives no piece."""
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: SQL can express neither a trained classifier nor the hashes and the tokenizer used here; tests/llm holds the stages
#: against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder. What a stage wrote for itself, and what came before it, is deleted."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        with temporary() as keep:
            docs = keep(written(stage(spark, before, sf_dir), f"stage-{name}"))
        drop_written(before)
    return STAGES[-1][1](spark, docs, sf_dir)
