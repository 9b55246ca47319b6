"""Collocations against brute force."""

import random
import re
from collections import Counter

import pytest

from sablefin.llm import collocations


def brute(rows, least, most_words):
    """{(lang, phrase): (a, l, r, score)} and {lang: n} of rows (lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, most_words + 1):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i : i + m])] += 1
    candidates = {x: a for x, a in f.items() if len(x[1]) >= 2 and a >= least}
    dropped = set()
    for (lang, words), a in candidates.items():
        for s in range(2, len(words)):
            for i in range(len(words) - s + 1):
                part = (lang, words[i : i + s])
                if 100 * a >= 80 * f[part]:
                    dropped.add(part)
    out = {}
    for (lang, words), a in candidates.items():
        if (lang, words) not in dropped:
            cuts = []
            for k in range(1, len(words)):
                l, r = f[lang, words[:k]], f[lang, words[k:]]
                cuts.append((2000000 * a // (l + r), k, l, r))
            score, _, l, r = min(cuts)
            out[lang, " ".join(words)] = (a, l, r, score)
    return out, {x: v for x, v in n.items() if v}


def made(seed, count=150):
    rng = random.Random(seed)
    words = ["New", "york", "CITY", "of", "the", "É", "é", "a b", "\x1c", "x", "-", " "] + [f"rare{i}" for i in range(40)]
    gaps = [" "] * 12 + ["\t", "  ", ". ", ", ", "\n", "\r\n", "\x0b", "!"]
    rows = []
    for _ in range(count):
        text = "".join(rng.choice(words[: rng.choice([6, 12, 52])]) + rng.choice(gaps) for _ in range(rng.randrange(0, 40)))
        rows.append((rng.choice(["en", "en", "en", "de", None, "und", ""]), text))
    return rows + [(None, None), ("en", ""), ("fr", None), ("en", "new york city " * 30), ("en", "z z z z z z z z z z")]


def found(spark, rows, least=5, most_words=4):
    df = spark.createDataFrame([(i, *r, "x", 1) for i, r in enumerate(rows)], "doc_id long, lang string, text string, a string, chunk int")
    phrases, totals = collocations.collocations(df, least=least, most_words=most_words)
    out = {(r["lang"], r["phrase"]): (r["a"], r["l"], r["r"], r["score"]) for r in phrases.collect()}
    return out, {r["lang"]: r["n"] for r in totals.collect() if r["n"]}


def test_equals_brute_force(spark):
    rows = made(1)
    assert found(spark, rows) == brute(rows, 5, 4)
    assert len(found(spark, rows)[0]) > 30


def test_small_chunks_and_shuffle_joins(spark, monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 50)
    monkeypatch.setattr(collocations, "BROADCAST_GRAMS", 0)
    monkeypatch.setattr(collocations, "NARROW_ROWS", 7)
    rows = made(2, 80) + [("en", "without any separator " * 40)]
    assert found(spark, rows, 4, 5) == brute(rows, 4, 5)


def test_ids_beyond_32_bits(spark, monkeypatch):
    """Keys that differ in the high bits alone stay apart."""
    plain = collocations.numbered
    monkeypatch.setattr(collocations, "numbered", lambda df, name: (lambda t: t.withColumn("id", (t["id"] % 3) * (1 << 32) + t["id"] / 3 + 1).withColumn("id", collocations.F.col("id").cast("long")))(plain(df, name)))
    rows = made(3, 100)
    assert found(spark, rows) == brute(rows, 5, 4)


def test_empty_table(spark):
    assert found(spark, []) == ({}, {})


@pytest.mark.parametrize("a, l, r", [(10**13, 10**13, 10**13), (3, 4, 5), (30, 10**12, 7)])
def test_exact_scores(spark, a, l, r):
    df = spark.sql(f"SELECT 2 AS m, {a}L AS a, array({l}L, {a}L) AS pre, array({r}L, {a}L) AS suf").selectExpr(f"({collocations._CUT}).score AS score")
    assert df.first()["score"] == 2000000 * a // (l + r)
