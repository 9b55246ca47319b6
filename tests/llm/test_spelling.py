"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

from sablefin.llm import spelling


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, ratio=5):
    out, form = {}, {}
    for w, n in counts.items():
        near = sorted((-m, x) for x, m in counts.items() if is_near(w, x))
        form[w] = near[0][1] if near and -near[0][0] >= ratio * n else None
        out[w] = [form[w], None, n, len(near), -near[0][0] if form[w] else None]
    for w in out:
        end = w
        while form[end]:
            end = form[end]
        out[w][1] = end
    return {w: tuple(x) for w, x in out.items()}


def found(spark, counts):
    df = spark.createDataFrame([(w, n, "x", 1) for w, n in counts], "word string, n int, form string, rank int")
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(df).collect()}


def words(seed, length=7, count=250, alphabet="aabé"):
    rng = random.Random(seed)
    out = {}
    for _ in range(count):
        w = "".join(rng.choices(alphabet, k=length + rng.randrange(-1, 2)))
        out[w] = 5 ** rng.randrange(1, 6) + rng.randrange(2)
    return out


def test_equals_all_pairs(spark):
    counts = words(1) | {"a": 7, "b": 40, "ab": 3, "\U0001f600x": 10, "x": 60, "lonely-word": 5, "aaaaaaaa": 5, "aaaaaaaaa": 25, "aaaaaaaaaa": 125}
    assert found(spark, counts.items()) == brute(counts)


def test_long_words_go_by_hashes(spark, monkeypatch):
    """Words on both sides of the border between texts and hashes as keys, and keys handed over in parts."""
    monkeypatch.setattr(spelling, "LITERAL", 7)
    monkeypatch.setattr(spelling, "KEY_ROWS", 5)
    counts = words(2, 8) | words(3, 6, 100)
    assert found(spark, counts.items()) == brute(counts)
    monkeypatch.setattr(spelling, "LITERAL", 0)
    assert found(spark, counts.items()) == brute(counts)


def test_very_long_words(spark):
    rng = random.Random(4)
    long = "".join(rng.choices("abcdé", k=3_000))
    counts = {long: 100, long[:17] + "z" + long[18:]: 10, long[1:]: 9, long + "a": 500, long[:5] + long[6:] + "y": 4, long[::-1]: 7}
    assert found(spark, counts.items()) == brute(counts)


def test_nulls_and_empty_tables(spark):
    assert found(spark, [(None, 5), ("word", None), ("", 5), ("wordy", 5)]) == {"wordy": (None, "wordy", 5, 0, None)}
    assert found(spark, []) == {}


def plain_counts(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 5}


def test_query_on_a_table(spark, tmp_path):
    rng = random.Random(6)
    pool = ["Letters", "LETTERS", "lettres", "better", "Übergröße", "×multiplied÷", "wordless", "short", "ab", "naïveté", "Iﬁne", "letter"] + ["w" + "".join(rng.choices("abc", k=5)) for _ in range(60)]
    docs = [(i % 50 if i % 17 else None, rng.choice([" ", "-", "\n", "1"]).join(rng.choices(pool, k=rng.randrange(0, 60)))) for i in range(400)]
    docs += [(6, "letters " * 9000 + "letterz " * 700 + "lexterz " * 9)]
    docs += [(1, None), (None, None), (2, ""), (3, "x" * 2_000), (3, "x" * 2_000)] + [(4, "y" * 99 + "z")] * 6
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.op11_spelling_variants(spark, str(tmp_path)).collect()}
    assert got == brute(plain_counts(docs))
    assert any(x[0] and x[0] != x[1] for x in got.values())
