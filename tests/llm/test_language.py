"""Code lengths against a plain model, and held-out accuracy."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from sablefin.llm import language
from sablefin.llm.common import is_held_out, sampled


def plain_bits(texts, text, order=language.ORDER):
    follow = defaultdict(Counter)
    for t in texts:
        for i in range(len(t)):
            for k in range(min(order, i) + 1):
                follow[t[i - k : i]][t[i]] += 1
    bits = 0.0
    for i in range(len(text)):
        for k in range(min(order, i), -2, -1):
            if k < 0:
                bits += 8
                break
            seen = follow.get(text[i - k : i])
            if not seen:
                continue
            n, d = sum(seen.values()), len(seen)
            if text[i] in seen:
                bits -= math.log2(seen[text[i]] / (n + d))
                break
            bits -= math.log2(d / (n + d))
    return bits


def test_code_lengths_are_exact():
    texts = {"aa": [b"abracadabra", b"abab", b""], "bb": [b"xyzzy abc", "été".encode()], "cc": []}
    tests = [b"abra", b"", b"xyz", b"\xff\x00q", b"abracadabra xyzzy" * 20, b"c", b"", "é".encode()]
    trees = language.grow(texts)
    raw, offsets = np.frombuffer(b"".join(tests), np.uint8), np.cumsum([0, *map(len, tests)])
    for chunk in (1, 3, 7, 64, 1 << 20):
        found = language.code_lengths(trees, raw, offsets, chunk=chunk)
        for j, name in enumerate(trees.languages):
            for i, text in enumerate(tests):
                assert abs(found[i, j] - plain_bits(texts[name], text)) <= 1e-5 * max(1, found[i, j]) + 1e-4


def test_letters():
    assert language.has_letter("ab".encode()) and language.has_letter("中".encode()) and not language.has_letter("12 ²³ !".encode()) and not language.has_letter(b"")


def test_edges(spark):
    rows = [(1, "the cat sat on the mat and the dog", "en"), (2, "die katze und der hund in dem haus", "de"), (3, None, "en"), (4, "", "de"), (5, "123 !", "en"), (6, "the dog", None), (6, "the dog", None)]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    found = language.identify(df, language.learn(df)).collect()
    by_id = {r.id: r for r in found}
    assert len(found) == 7 and by_id[6].lang_pred == "en" and by_id[2].lang_pred == "de"
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (3, 4, 5))
    nothing = language.learn(df.where("false"))
    assert {r.lang_pred for r in language.identify(df, nothing).collect()} == {"und"}
    assert language.identify(df.limit(0), language.learn(df)).count() == 0


def test_query_equals_plain_code_lengths(spark, monkeypatch):
    rng = random.Random(3)
    rows = []
    for i in range(90):
        lang = ["aa", "bb", "cc", "dd", "ee", None][i % 6]
        letters = {"aa": "abcde ", "bb": "defgh ", "cc": "ghijk ", "dd": "é漢klm ", "ee": "mnopq "}.get(lang, "abcdefghij ")
        rows.append((i % 80, "".join(rng.choice(letters) for _ in range(rng.randrange(60))), lang))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts = {}
    for _, text, lang in rows:
        if lang:
            texts.setdefault(lang, []).append(text.encode())
    found = []
    for together in (2, 8):
        monkeypatch.setattr(language, "TOGETHER", together)
        found.append(sorted(tuple(r) for r in language.identify(df, language.learn(df)).collect()))
    assert found[0] == found[1]
    plain = []
    for key, text, _ in rows:
        bits = {k: plain_bits(v, text.encode()) for k, v in texts.items()}
        best = min(sorted(bits), key=lambda k: bits[k])
        some = any(c.isalpha() for c in text)
        plain.append((key, best if some else "und", 1 / sum(2.0 ** -(b - bits[best]) for b in bits.values()) if some else 0.0))
    for mine, theirs in zip(found[0], sorted(plain)):
        assert mine[:2] == theirs[:2] and abs(mine[2] - theirs[2]) < 1e-3


def test_sample_is_bounded_whatever_repeats(spark):
    rows = [(7, f"text {i} of one id", "en") for i in range(3000)] + [(8, "same", "en")] * 2000 + [(9, "x" * 50_000, "de"), (10, "kurz", "de"), (11, "y" * 90, None)]
    df = spark.createDataFrame(rows, "id long, text string, group string").where("group IS NOT NULL")
    found = sampled(df, {"en": 100, "de": 100}, 2000, "s")
    assert len(found["en"]) <= 100 and sum(map(len, found["en"])) <= 2000 and len(set(found["en"])) == len(found["en"])
    assert found["de"] == [b"kurz"]
    assert found == sampled(df.repartition(5), {"en": 100, "de": 100}, 2000, "s")
    assert sampled(df, {"en": 5, "de": 5}, 1, "s")["de"] == [b"kurz"]
    assert sampled(df.limit(0), {"en": 5}, 10, "s") == {}


def test_held_out_rows_change_nothing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = is_held_out(4, 2)
    turned = docs.withColumn("lang", F.when(out, F.lit("xx")).otherwise(F.col("lang")))
    a, b = (language.identify(docs, language.learn(d.where(~out))).orderBy("id").collect() for d in (docs, turned))
    assert a == b


def test_query(spark, sf_dir):
    found = language.op9_language_id(spark, sf_dir)
    assert found.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = found.join(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == r.lang for r in held]) >= 0.95
