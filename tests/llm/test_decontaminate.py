"""Decontamination against brute force over all windows."""

import random
import re
from collections import Counter

import pytest

from sablefin.llm import decontaminate


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def shingles(ws, size):
    return Counter(tuple(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1)))


def brute(docs, items):
    out = {}
    for item, text in items:
        own = words(text)
        if not own:
            continue
        size = min(5, len(own))
        wanted = shingles(own, size)
        for key, doc in docs:
            ws = words(doc)
            best = 0.0
            for start in range(len(ws)):
                window = ws[start : start + len(own)]
                found = shingles(window, size)
                similarity = sum((found & wanted).values()) / sum((found | wanted).values())
                if similarity >= 0.8 and similarity > best:
                    best = similarity
                    out[key, item] = (start, len(window), round(similarity, 9))
    return out


def found(spark, docs, items):
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in docs], "doc_id long, text string, words string, n int")
    bench = spark.createDataFrame([(k, t, 1) for k, t in items], "item_id long, text string, n int")
    rows = decontaminate.contaminated(df, bench).collect()
    assert all(r.distance <= decontaminate.RADIUS for r in rows)
    return {(r.doc_id, r.item_id): (r.start_word, r.n_words, round(r.similarity, 9)) for r in rows}


def planted():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(some(rng.choice([6, 12, 25, 40, 60, 120])))) for i in range(20)]
    items += [(50, "three word item"), (51, "single"), (52, ""), (53, None), (54, items[0][1]), (55, "Rep rep REP rep rep rep rep rep rep rep")]
    docs = []
    for i in range(60):
        item = words(rng.choice(items)[1])
        edited = list(item)
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            if edited:
                at = rng.randrange(len(edited))
                edited[at : at + rng.choice([0, 1, 1])] = some(rng.choice([0, 1, 1]))
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(some(rng.randrange(30)) + edited + some(rng.randrange(30)))))
    docs += [(100, None), (101, ""), (102, "  "), (103, items[3][1].upper()), (103, items[3][1]), (104, " ".join(words(items[5][1])[:-1])), (105, "w1 " * 4000 + items[4][1])]
    docs += [(106, "a three word item here"), (107, "three words item"), (108, "rep " * 50), (109, "So: single!"), (None, items[2][1])]
    return docs, items


@pytest.mark.parametrize("inline", [8192, 0])
def test_equals_brute_force(spark, monkeypatch, inline):
    monkeypatch.setattr(decontaminate, "INLINE", inline)
    docs, items = planted()
    assert found(spark, docs, items) == brute(docs, items)


def test_items_with_swapped_halves(spark):
    rng = random.Random(9)
    some = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    items, docs = [], []
    for i, n in enumerate((40, 60, 120)):
        item = some(n)
        items.append((i, " ".join(item)))
        docs.append((i, " ".join(some(25 * i) + item[n // 2 :] + item[: n // 2] + some(30))))
    expected = brute(docs, items)
    assert set(expected) == {(0, 0), (1, 1), (2, 2)} and found(spark, docs, items) == expected


def test_texts_of_one_id_are_kept_apart(spark):
    rng = random.Random(10)
    some = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    items = [(i, some(30)) for i in range(4)]
    docs = [(None, items[0][1]), (None, items[1][1]), (None, some(30)), (7, items[2][1]), (7, items[3][1]), (7, some(40)), (7, None)]
    assert set(found(spark, docs, items)) == {(None, 0), (None, 1), (7, 2), (7, 3)}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    left = decontaminate.without_leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(map(str, left)) == sorted(str(r) for r in df.collect() if (r.doc_id, r.text) in [docs[2], docs[5], docs[6]])


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a b c d e f")]) == {}
    assert found(spark, [(1, "a b c d e f")], []) == {}
    assert found(spark, [(1, "a b c d e f")], [(1, None)]) == {}


def test_leaking_documents_go_and_others_stay(spark):
    docs, items = planted()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    gone = {key for key, _ in brute(docs, items)}
    assert {r.doc_id for r in decontaminate.without_leaks(df, bench).collect()} == {k for k, _ in docs} - gone


def test_no_python_on_the_main_path(spark, sf_dir, monkeypatch):
    plans, inner = [], decontaminate.written
    monkeypatch.setattr(decontaminate, "written", lambda df, name: plans.append(df._jdf.queryExecution().toString()) or inner(df, name))
    decontaminate.op1_benchmark_decontamination(spark, sf_dir).collect()
    assert len(plans) >= 4 and not any(re.search("Python|Pandas|MapInArrow|ArrowEval", plan) for plan in plans)


@pytest.mark.parametrize("inline", [8192, 0])
def test_items_of_very_different_lengths_share_shingles(spark, monkeypatch, inline):
    monkeypatch.setattr(decontaminate, "INLINE", inline)
    rng = random.Random(12)
    long = [f"w{rng.randrange(3000)}" for _ in range(400)]
    items = [(0, " ".join(long)), (1, " ".join(long[:6])), (2, " ".join(long[3:6])), (3, " ".join(long[100:130])), (4, long[7])]
    docs = [(i, " ".join([f"x{i}"] * i + long[a:b] + ["end"] * (5 - i % 5))) for i, (a, b) in enumerate([(0, 400), (0, 350), (0, 20), (2, 8), (95, 140), (7, 8), (30, 400)])]
    assert found(spark, docs, items) == brute(docs, items)


def test_very_long_texts(spark):
    item = " ".join(f"w{i}" for i in range(30))
    docs = [(1, "filler words " * 100_000 + item + " end" * 100_000), (2, "filler words " * 100_000)]
    assert set(found(spark, docs, [(1, item)])) == {(1, 1)}


def test_near_all_similar_windows_are_within_the_radius(spark):
    """What the radius misses of edited items with similarity 0.8 or more: at most one in 500 of these."""
    rng = random.Random(13)
    items, docs = [], []
    for i in range(500):
        item = [f"w{rng.randrange(20_000)}" for _ in range(rng.choice([25, 40, 80]))]
        edited = list(item)
        for _ in range(rng.choice([1, 2])):
            edited[rng.choice([0, 1, len(edited) - 1, rng.randrange(len(edited))])] = f"e{rng.randrange(10**6)}"
        items.append((i, " ".join(item)))
        docs.append((i, " ".join(edited)))
    expected, mine = brute(docs[:0], items[:0]), set(found(spark, docs, items))
    for (i, item), (_, doc) in zip(items, docs):
        expected |= brute([(i, doc)], [(i, item)])
    assert len(expected) > 200 and len(set(expected) - mine) <= len(expected) / 500 + 1
