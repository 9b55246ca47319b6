"""The toxicity classifier: parts, held-out accuracy, and what it may not look at."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sablefin.llm import toxicity
from sablefin.llm.common import is_held_out

RNG = random.Random(5)
WORDS = ["".join(RNG.choice("abcdefgh") for _ in range(6)) for _ in range(400)]


def made(n, start=0, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(start, start + n):
        words = [rng.choice(WORDS) for _ in range(rng.choice([20, 60, 300]))]
        bad = rng.random() < 0.3
        if bad:
            for _ in range(max(2, len(words) // 40)):
                words.insert(rng.randrange(len(words)), rng.choice(["zounds", "foozles"]))
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_chunks_change_nothing():
    rows = made(80)
    model = toxicity.train([t.encode() for _, t, _ in rows], np.array([y for *_, y in rows]))
    text = np.frombuffer(rows[0][1].encode(), np.uint8)
    for part in (text, text[:0], text[:1], text[:4]):
        for chunk in (1, 3, 100):
            assert toxicity.score(model, part, chunk) == toxicity.score(model, part)
            mine = np.sort(np.concatenate([np.empty(0, np.int32), *toxicity._in_chunks(part, chunk)]))
            assert (mine == np.sort(np.concatenate([np.empty(0, np.int32), *toxicity.grams(part)]))).all()


def plain_buckets(text):
    """The n-grams of a text, counted by bucket, one by one."""
    folded = b" " + bytes(b + 32 if 65 <= b <= 90 else 32 if b in b"\t\n\x0b\x0c\r" else b for b in text) + b" "
    found = Counter()
    for n in (3, 4, 5):
        for i in range(len(folded) - n + 1):
            value = int.from_bytes(folded[i : i + n], "little") + (n << 56)
            found[(value * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 43] += 1
    return found


def plain_scores(texts, toxic):
    """Features, naive Bayes ratios and logistic regression on a dense table; no code shared with the operator."""
    counts = [plain_buckets(t) for t in texts]
    kinds = sorted({(0, b) for c in counts for b in c} | {(1, b) for c in counts for b in c})
    x = np.array([[float(c[b] > 0 and (kind == 0 or c[b] * 1000 >= len(t))) for kind, b in kinds] for c, t in zip(counts, texts)])
    y = np.asarray(toxic, float)
    often = x.sum(axis=0) >= 4
    x = x[:, often]
    n_1, n_0 = y.sum(), (1 - y).sum()
    in_1, in_0 = x[y == 1].sum(axis=0), x[y == 0].sum(axis=0)
    ratio = np.log((in_1 + 1) / (n_1 + 2)) - np.log((in_0 + 1) / (n_0 + 2))
    share = (in_1 + in_0) / len(y)
    apart = np.abs(in_1 / n_1 - in_0 / n_0) / np.sqrt(np.maximum(share * (1 - share) * (1 / n_1 + 1 / n_0), 1e-300))
    x = (x * ratio)[:, (apart > 0) & (share < 1)]
    assert x.shape[1] <= toxicity.FEATURES
    w, m, v = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    w[-1] = np.log(n_1 / n_0)
    for t in range(1, 301):
        error = (1 / (1 + np.exp(-(x @ w[:-1] + w[-1]))) - y) * np.where(y == 1, 0.5 / n_1, 0.5 / n_0)
        slope = np.append(x.T @ error + 2e-3 * w[:-1], error.sum())
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))


def test_scores_equal_a_plain_computation(spark):
    rows = [(k, " ".join(t.split()[:14]), y) for k, t, y in made(50, seed=3)]
    rows = [(k, "Zounds " + t if y else t, y) for k, t, y in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    found = toxicity.classify(df, toxicity.learn(df, df.select("doc_id", "toxic"))).orderBy("id").collect()
    plain = plain_scores([t.encode() for _, t, _ in rows], [y for *_, y in rows])
    assert np.abs(np.array([r.score for r in found]) - plain).max() < 1e-6


def test_one_id_with_many_texts_stays_bounded(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "train", lambda texts, toxic: (len(texts), sum(map(len, texts))))
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 4000)
    df = spark.createDataFrame([(1, f"some text {i}") for i in range(5000)] + [(2, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    count, size = toxicity.learn(df, labels, sample={0: 400, 1: 400})
    assert 100 < count <= 401 and size <= 4000 + 5


def test_each_gram_has_its_bucket():
    found = [g.tolist() for g in toxicity.grams(np.frombuffer(b"Ab c", np.uint8))]
    assert [len(g) for g in found] == [4, 3, 2]
    assert found == [g.tolist() for g in toxicity.grams(np.frombuffer(b"aB\nc", np.uint8))]


def test_held_out_accuracy_and_edges(spark):
    rows = made(400)
    extra = [(1000, None, 0), (1001, "", 1), (1002, "", 0), (5, rows[5][1], rows[5][2]), (None, "zounds foozles zounds", 1)]
    df = spark.createDataFrame([(k, t, "x", 9.0) for k, t, _ in rows + extra], "doc_id long, text string, toxic string, score double")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows + extra] + [(3, None), (None, 1)], "doc_id long, toxic int")
    held_out = is_held_out(5, 0)
    model = toxicity.learn(df, labels.where(~held_out))
    found = toxicity.classify(df, model).withColumn("out", is_held_out(5, 0, "id")).collect()
    assert len(found) == len(rows) + len(extra)
    truth = {k: y for k, _, y in rows}
    out = [r for r in found if r.out and r.id in truth]
    assert np.mean([r.predicted == truth[r.id] for r in out]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    empty = {r.score for r in found if r.id in (1000, 1001, 1002)}
    assert len(empty) == 1


def test_held_out_labels_change_nothing(spark):
    rows = made(150)
    df = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    turned = labels.withColumn("toxic", F.when(is_held_out(5, 0), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = [toxicity.classify(df, toxicity.learn(df, x.where(~is_held_out(5, 0)))).orderBy("id").collect() for x in (labels, turned)]
    assert scores[0] == scores[1]


def test_without_labels(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.classify(df, toxicity.learn(df, labels)).collect()} == {0}
    assert toxicity.classify(df.limit(0), toxicity.learn(df, labels)).count() == 0


def test_sample_is_bounded(spark):
    rows = made(400)
    df = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    model = toxicity.learn(df, labels, sample={0: 60, 1: 60})
    found = toxicity.classify(df, model).collect()
    truth = {k: y for k, _, y in rows}
    assert np.mean([r.predicted == truth[r.id] for r in found]) > 0.8


def test_query(spark, sf_dir):
    found = toxicity.op5_toxicity(spark, sf_dir)
    assert found.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = found.collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


@pytest.mark.slow
def test_held_out_accuracy_on_the_tables(spark):
    sf_dir = "/root/testdata/sf0.1"
    found = toxicity.op5_toxicity(spark, sf_dir).where("held_out").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").collect()
    assert np.mean([r.predicted == r.toxic for r in found]) >= 0.96
    clean = [r.predicted for r in found if r.toxic == 0]
    assert np.mean(clean) <= 0.02
