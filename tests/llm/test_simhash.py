"""SimHash groups against brute force."""

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from sablefin.llm import simhash


def roots(count, pairs):
    parent = list(range(count))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    return [find(x) for x in range(count)]


def same_partition(a, b):
    return len(set(a)) == len(set(b)) == len(set(zip(a, b)))


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_fingerprint_equals_a_plain_one():
    rng = random.Random(1)
    words = ["a", "B", "été", "word", "x\x1cy", "Ü", "nbsp here"]
    for n in (0, 1, 2, 3, 4, 50, 9000):
        text = "".join(rng.choice(words) + rng.choice([" ", "\n", " \t ", "\x0b"]) for _ in range(n))
        assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_spark_hashes_alike(spark):
    found = spark.range(1).select(F.xxhash64(F.lit("a b ç"))).first()[0]
    assert found & (1 << 64) - 1 == xxhash.xxh64_intdigest("a b ç".encode(), 42)


def test_spanning_links_connect_what_links_connect():
    rng = random.Random(2)
    for n in (1, 2, 24, 25, 64, 65, 400):
        bases = [rng.getrandbits(64) for _ in range(max(2, n // 20))]
        values = list({rng.choice(bases) ^ 1 << rng.randrange(64) ^ rng.choice([0, 1]) << rng.randrange(64) for _ in range(n)})
        links = simhash.spanning_links(np.array(values, np.uint64))
        assert all((values[a] ^ values[b]).bit_count() <= 2 for a, b in links)
        assert len(links) < len(values)
        brute = [(a, b) for a in range(len(values)) for b in range(a) if (values[a] ^ values[b]).bit_count() <= 2]
        assert same_partition(roots(len(values), links), roots(len(values), brute))


def test_within_gives_up_nothing_too_early():
    rng = random.Random(3)
    values = np.array([rng.getrandbits(64) for _ in range(200)], np.uint64)
    query = int(values[7])
    for radius in (0, 1, 2, 3, 7, 30):
        lanes = np.packbits((np.arange(256) < 200).astype(np.uint8), bitorder="little").view("<u8")
        found = simhash.within(simhash.bit_planes(values), lanes, query, radius)
        bits = np.flatnonzero(np.unpackbits(found.view(np.uint8), bitorder="little")).tolist()
        assert bits == [i for i, v in enumerate(values.tolist()) if (v ^ query).bit_count() <= radius]


def test_small_buckets_go_through_planes(monkeypatch):
    rng = random.Random(6)
    buckets = []
    for _ in range(300):
        base = rng.getrandbits(64)
        buckets.append(np.array(list({base ^ 1 << rng.randrange(64) ^ rng.choice([0, 1, 6]) << rng.randrange(60) for _ in range(rng.randrange(7))}), np.uint64))
    calls = []
    inner = simhash.within
    monkeypatch.setattr(simhash, "within", lambda planes, *rest: calls.append(planes.shape) or inner(planes, *rest))
    found = simhash.small_links(buckets)
    for values, near in zip(buckets, found):
        numbers = values.tolist()
        brute = {(a, b) for b in range(len(numbers)) for a in range(b) if (numbers[a] ^ numbers[b]).bit_count() <= 2}
        assert {tuple(x) for x in near.tolist()} == brute
    pairs = sum(len(x) * (len(x) - 1) // 2 for x in buckets)
    assert calls == [(64, -(-pairs // 64))]
    assert all(len(x) == 0 for x in simhash.small_links([np.empty(0, np.uint64), np.array([5], np.uint64)]))


def brute_components(rows):
    prints = [plain_fingerprint(t or "") for _, t in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2]
    root = roots(len(rows), pairs)
    least = {}
    for r, (key, _) in zip(root, rows):
        if key is not None:
            least[r] = min(key, least.get(r, key))
    return sorted(((k, f, least.get(r)) for (k, _), f, r in zip(rows, prints, root)), key=str)


def test_components_with_copies_nulls_and_chains(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", 4)
    rng = random.Random(4)
    base = [rng.choice("abcdefgh") * 3 for _ in range(400)]
    rows = [(1, None), (2, ""), (3, " \n"), (None, "lonely words here"), (5, "one"), (5, "one"), (6, "One")]
    for i in range(40):
        words = list(base)
        for _ in range(rng.randrange(3)):
            words[rng.randrange(400)] = "edit"
        rows.append((100 + i, " ".join(words)))
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, fp string, component int")
    found = sorted(((r.id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert found == brute_components(rows)
    kept = {(r.doc_id) for r in simhash.keep_first(df).collect()}
    assert kept == {c for _, _, c in found}


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    expected = {(k, f"{f:016x}", c) for k, f, c in brute_components([tuple(r) for r in docs])}
    assert {tuple(r) for r in simhash.op7_simhash_near_dedup(spark, sf_dir).collect()} == expected


def test_long_texts_and_empty_tables(spark):
    long = "word " * 400_000
    rows = [(1, long), (2, long + "x"), (3, "word " * 3)]
    found = {r.id: r for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1].fp & (1 << 64) - 1 == plain_fingerprint("word " * 3) and {r.component_id for r in found.values()} == {1}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_first(empty).count() == 0


def test_texts_of_one_id_go_with_their_own_group(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(80)) for c in "ab")
    rows = [(1, one), (5, one), (5, two), (6, two), (None, two)]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(1, one), (5, two), (None, two)], key=str)
