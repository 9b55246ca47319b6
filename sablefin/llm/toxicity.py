"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_broadcast, buffers, is_held_out, sampled, small_batches, table, utf8

#: Lengths of the byte n-grams, and how many hash buckets they share.
GRAMS, BUCKETS = (3, 4, 5), 1 << 21
#: Labelled documents that are learned from at most, by label, and the bytes of a label's texts; whole texts are used.
SAMPLE, SAMPLE_BYTES = {1: 3000, 0: 5000}, 24 << 20
#: An n-gram is dense in a text if it stands there at least once in so many bytes.
DENSE = 1000
#: Features that keep a weight: those that tell the labels apart best.
FEATURES = 1 << 12
SMOOTHING = 1.0
#: A feature counts only if so many sampled documents have it.
LEAST_DOCS = 4
_FOLD = np.array([b + 32 if 65 <= b <= 90 else 32 if b in (9, 10, 11, 12, 13) else b for b in range(256)], np.uint8)
_SALT = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Model:
    """``slot[bucket]`` is the bucket's place among the kept ones, or -1; ``present`` and ``dense`` are the weights, ratio
    included, of its n-grams' standing in a text at all and of their being dense there."""

    slot: np.ndarray
    present: np.ndarray
    dense: np.ndarray
    bias: float


def _hashed(folded: np.ndarray, starts: int) -> Iterator[np.ndarray]:
    """The buckets of the n-grams that begin at the first ``starts`` places, one array for each length."""
    for n in GRAMS:
        count = min(starts, len(folded) - n + 1)
        if count <= 0:
            continue
        value = folded[:count].copy()
        for i in range(1, n):
            value |= folded[i : count + i] << np.uint64(8 * i)
        yield ((value + np.uint64(n << 56)) * _SALT >> np.uint64(64 - 21)).astype(np.int32)


def _in_chunks(text: np.ndarray, chunk: int) -> Iterator[np.ndarray]:
    """The buckets of a text's n-grams in parts; a blank stands before and after the text."""
    total = len(text) + 2
    for at in range(0, total, chunk):
        stop = min(at + chunk + max(GRAMS) - 1, total)
        parts = [np.full(int(at == 0), 32, np.uint8), _FOLD[text[max(at - 1, 0) : stop - 1]], np.full(int(stop == total), 32, np.uint8)]
        yield from _hashed(np.concatenate(parts).astype(np.uint64), chunk)


def grams(text: np.ndarray) -> Iterator[np.ndarray]:
    """The buckets of a text's n-grams, one array for each length."""
    return _in_chunks(text, len(text) + 2)


def features(text: np.ndarray) -> np.ndarray:
    """The buckets of a text's n-grams, and behind all buckets once more those of its dense ones."""
    seen, counts = np.unique(np.concatenate([np.empty(0, np.int32), *grams(text)]), return_counts=True)
    return np.concatenate([seen, BUCKETS + seen[counts * DENSE >= len(text)]]).astype(np.int32)


def train(texts: list[bytes], toxic: np.ndarray, rounds: int = 300, ridge: float = 2e-3) -> Model:
    """Logistic regression on the presence and the density of n-grams, each scaled by its naive Bayes log-count ratio.

    Without examples of both labels every text has the share of toxic ones (0 without any) as its score.
    """
    toxic = np.asarray(toxic, bool)
    n_1, n_0 = int(toxic.sum()), int((~toxic).sum())
    if not n_1 or not n_0:
        return Model(np.full(BUCKETS, -1, np.int32), np.zeros(0), np.zeros(0), 20.0 if n_1 else -20.0)
    df = np.zeros((2, 2 * BUCKETS), np.int32)
    for text, label in zip(texts, toxic):
        df[int(label), features(np.frombuffer(text, np.uint8))] += 1
    often = np.flatnonzero(df[0] + df[1] >= LEAST_DOCS)
    in_0, in_1 = df[0, often], df[1, often]
    del df
    ratio = np.log((in_1 + SMOOTHING) / (n_1 + 2 * SMOOTHING)) - np.log((in_0 + SMOOTHING) / (n_0 + 2 * SMOOTHING))
    # How far the share of documents with the feature differs between the labels, in standard errors.
    share = (in_0 + in_1) / (n_1 + n_0)
    with np.errstate(divide="ignore", invalid="ignore"):
        apart = np.abs(in_1 / n_1 - in_0 / n_0) / np.sqrt(share * (1 - share) * (1 / n_1 + 1 / n_0))
    apart = np.where(np.isfinite(apart), apart, 0)
    best = np.argsort(-apart, kind="stable")[:FEATURES]
    best = np.sort(best[apart[best] > 0])
    kept, scale = often[best], ratio[best]
    slot = np.full(2 * BUCKETS, -1, np.int32)
    slot[kept] = np.arange(len(kept))
    # Features are computed again rather than held: only the kept ones' places stay in memory.
    columns = [s[s >= 0] for s in (slot[features(np.frombuffer(t, np.uint8))] for t in texts)]
    row = np.repeat(np.arange(len(texts)), [len(c) for c in columns])
    column = np.concatenate(columns) if columns else np.empty(0, np.int32)
    value = scale[column]
    weight, bias, step = np.zeros(len(kept)), float(np.log(n_1 / n_0)), 0.05
    each = np.where(toxic, 0.5 / n_1, 0.5 / n_0)
    moment, square = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    for t in range(1, rounds + 1):
        z = np.bincount(row, weight[column] * value, len(texts)) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic) * each
        slope = np.append(np.bincount(column, error[row] * value, len(kept)) + ridge * weight, error.sum())
        moment, square = 0.9 * moment + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        move = step * (moment / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
        weight -= move[:-1]
        bias -= move[-1]
    buckets = np.unique(kept % BUCKETS)
    place = np.full(BUCKETS, -1, np.int32)
    place[buckets] = np.arange(len(buckets))
    by_feature = np.append(weight * scale, 0.0)
    return Model(place, by_feature[slot[buckets]], by_feature[slot[BUCKETS + buckets]], float(bias))


def score(model: Model, text: np.ndarray, chunk: int = 1 << 20) -> float:
    """How likely label 1 is for a whole text, which is read ``chunk`` bytes at a time."""
    counts = np.zeros(len(model.present), np.int64)
    if len(counts):
        for found in _in_chunks(text, chunk):
            slots = model.slot[found]
            counts += np.bincount(slots[slots >= 0], minlength=len(counts))
    z = model.present[counts > 0].sum() + model.dense[(counts > 0) & (counts * DENSE >= len(text))].sum() + model.bias
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def learn(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
    sample: dict[int, int] | None = None,
) -> Model:
    """The classifier learned from up to ``sample[label]`` documents of each label and ``SAMPLE_BYTES`` of their texts.

    How many rows each label has is counted over all; twice as many ids as are wanted are drawn by hash, and of their rows
    those with the smallest hashes of id and text. Only the sample's texts reach the driver, however often an id repeats.
    Labels other than 0 and 1, null ids and null texts are passed over; of several labels of an id the largest counts.
    """
    small_batches(docs.sparkSession)
    sample = sample or SAMPLE
    known = F.col(label_column).isin(0, 1) & F.col(id_column).isNotNull()
    marked = labels.where(known).groupBy(id_column).agg(F.max(label_column).cast("int").alias("group"))
    sizes = {r[0]: r[1] for r in marked.groupBy("group").count().collect()}
    share = {k: min(1_000_000, 2_000_000 * n // sizes[k]) for k, n in sample.items() if sizes.get(k)}
    if not share:
        return train([], np.empty(0))
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), F.col(id_column)), F.lit(1_000_000))
    wanted = F.create_map(*(F.lit(x) for pair in share.items() for x in pair))
    drawn = bounded_broadcast(marked.where(draw < wanted[F.col("group")]).select(F.col(id_column).alias("__id"), "group"))
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).where("text IS NOT NULL")
    found = sampled(texts.join(drawn, F.col("id") == F.col("__id")).select("group", "id", "text"), sample, SAMPLE_BYTES, "toxic")
    rows = [(text, label) for label in sorted(found) for text in found[label]]
    return train([t for t, _ in rows], np.array([y for _, y in rows]))


def classify(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (id, score, predicted): how likely each whole text is toxic, from its characters alone.

    Null texts count as empty and have the score of a text without any n-gram. Repeated rows keep a row each; other
    columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            raw, offsets = buffers(batch.column(1))
            cuts = offsets.tolist()
            found = np.array([score(model, raw[a:b]) for a, b in zip(cuts[:-1], cuts[1:])], np.float64)
            predicted = pa.array((found >= 0.5).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), predicted], names=["id", "score", "predicted"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("id"), utf8(text_column).alias("text")).mapInArrow(run, f"id {kind}, score double, predicted int")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document; a fifth of the documents is held out from learning."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = is_held_out(5, 0)
    found = classify(docs, learn(docs, labels.where(~held_out)))
    return found.withColumnRenamed("id", "doc_id").select("doc_id", held_out.alias("held_out"), "score", "predicted")
