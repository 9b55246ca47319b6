"""Repeated passages: planted ones are found, nothing else is, and brute force agrees on the parts."""

import random
import tracemalloc

import numpy as np
import pytest

from sablefin.llm import substrings


def words_hash(words):
    return substrings.words_of([" ".join(words).encode()])[0]


def ends(words):
    return np.array([0, len(words)])


def test_words_and_lines():
    hashes, lines, texts = substrings.words_of(["One two\n\n three\tONE \n".encode(), b"", b"two"])
    assert len(hashes) == 5 and hashes[0] == hashes[3] and hashes[1] == hashes[4]
    assert lines.tolist() == [0, 2, 4, 5] and texts.tolist() == [0, 4, 4, 5]
    assert [x.tolist() for x in substrings.words_of([b""])] == [[], [0], [0, 0]]


def test_texts_on_end_are_cut_as_each_alone():
    rng = random.Random(3)
    powers = substrings._powers(substrings._BASE, 1 << 13)
    for size in (12, 51):
        texts = [" ".join(f"w{rng.randrange(kinds)}" + rng.choice(["", "", "\n"]) for _ in range(rng.choice([0, 1, 4, 30, 60, 200]))).encode() for kinds in (1, 2, 5, 900) * 6]
        together = substrings.paragraphs(*substrings.words_of(texts), powers, size)
        alone = [substrings.paragraphs(*substrings.words_of([t]), powers, size) for t in texts]
        for i, one in enumerate(alone):
            own = together[0] == i
            for a, b in zip(together[1:5], one[1:5]):
                assert (a[own] == b).all()
            assert (together[5][own][:, 0] == one[5][:, 0]).all()


def test_inner_paragraphs_depend_on_their_surroundings_alone():
    rng = random.Random(1)
    for kinds in (1, 2, 3, 999):
        inner = [f"w{rng.randrange(kinds)}" for _ in range(51)]
        cuts = []
        for _ in range(20):
            before = [f"w{rng.randrange(kinds)}" for _ in range(rng.randrange(50))]
            after = [f"w{rng.randrange(kinds)}" for _ in range(rng.randrange(50))]
            whole = words_hash([*before, *inner, *after])
            found, chosen = substrings.inner_cuts(whole, ends(whole), 51)
            first, last = chosen[len(before)], chosen[len(before) + 24]
            assert len(before) <= first < last <= len(before) + 46
            cuts.append(tuple(c - len(before) for c in found.tolist() if first <= c <= last))
        assert len(set(cuts)) == 1 and len(cuts[0]) >= 2


def test_contents_are_equal_for_equal_words_alone():
    words = words_hash([f"w{i % 7}" for i in range(60)])
    starts = np.arange(0, 50)
    found = substrings.contents(words, starts, starts + 10, substrings._powers(substrings._BASE, 64))
    assert all((found[i] == found[j]) == (i % 7 == j % 7) for i in range(50) for j in range(50))


def test_similar_links_equal_brute_force():
    rng = random.Random(2)
    sets = [np.unique(np.array([rng.randrange(12) for _ in range(8)] + list(range(20, 50)), np.int64)) for _ in range(25)]
    sets += [np.array([1000 + i], np.int64) for i in range(5)]
    linked = substrings.similar_links([True] * len(sets), sets)
    jaccard = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert all(jaccard(sets[a], sets[b]) >= 0.8 for a, b in linked)

    def roots(pairs):
        parent = list(range(len(sets)))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            parent[find(a)] = find(b)
        return [find(i) for i in range(len(sets))]

    brute = [(a, b) for a in range(len(sets)) for b in range(a) if jaccard(sets[a], sets[b]) >= 0.8]
    a, b = roots(linked), roots(brute)
    assert len(set(zip(a, b))) == len(set(a)) == len(set(b))


def corpus():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    lay = lambda ws: "".join(w + rng.choice([" ", " ", " ", "\n"]) for w in ws)
    docs, planted = [], []
    for size in (30, 50, 51, 52, 55, 60, 70, 100) * 5:
        passage, first, at = some(size), None, 0
        for _ in range(3):
            before, after = some(rng.randrange(80)), some(rng.randrange(80))
            key = len(docs)
            docs.append((key, lay(before + passage + after)))
            if first is not None:
                mine, theirs = docs[key][1].split(), docs[first][1].split()
                left = right = 0
                while min(len(before) - left, at - left) > 0 and mine[len(before) - left - 1] == theirs[at - left - 1]:
                    left += 1
                while mine[len(before) + size + right :][:1] == theirs[at + size + right :][:1] != []:
                    right += 1
                if left + size + right > 50:
                    planted.append((key, len(before) - left, left + size + right, first))
            else:
                first, at = key, len(before)
    for _ in range(60):
        docs.append((len(docs), lay(some(200))))
    return docs, planted


def test_planted_passages_are_found_and_nothing_else(spark):
    docs, planted = corpus()
    rows = substrings.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {(r.id, r.start, r.n, r.kept) for r in rows} == set(planted)  # word by word, and none of 50 words or fewer


def test_passages_whose_stretches_stand_in_smaller_ids(spark):
    rng = random.Random(5)
    some = lambda n: [f"w{rng.randrange(100000)}" for _ in range(n)]
    docs, planted = [], set()
    for i, size in enumerate((51, 53, 57, 61, 65) * 4):
        passage, first = some(size), 100 + 2 * i
        cuts = substrings.inner_cuts(words_hash(passage), np.array([0, size]), 51)[0].tolist()
        inner = list(zip(cuts[1:], cuts[2:-1]))
        if i % 2:  # a stretch at one end alone, or each of them, in documents of their own
            inner = [inner[0 if i % 4 == 1 else -1]]
        for j, (a, b) in enumerate(inner):
            docs.append((10_000 * -(i + 1) + j, " ".join(some(20) + passage[max(a - 5, 0) : b + 6] + some(20))))
        for key, at in ((first, 30), (first + 1, 10)):
            docs.append((key, " ".join(some(at) + passage + some(25))))
        planted.add((first + 1, 10, size))
    rows = substrings.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {(r.id, r.start, r.n) for r in rows if r.id % 2} == planted


def test_passages_of_repeated_words_are_found(spark):
    rng = random.Random(6)
    some = lambda n: [f"w{rng.randrange(100000)}" for _ in range(n)]
    docs, planted = [], set()
    for i in range(24):
        size, period = (51, 60, 120, 300)[i % 4], some(i // 4 + 1)
        passage = (period * size)[:size]
        for key, before in ((2 * i, rng.randrange(40)), (2 * i + 1, 10)):
            docs.append((key, " ".join([*some(before), *passage, *some(rng.randrange(40))])))
        planted.add((2 * i + 1, 10, size, 2 * i))
    docs.append((99, " ".join([*some(20), *["ha"] * 50, *some(20)])))
    docs.append((100, " ".join([*some(20), *["ha"] * 50, *some(20)])))
    rows = substrings.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {(r.id, r.start, r.n, r.kept) for r in rows} == planted


def test_candidate_stretches_lose_no_passage():
    rng = random.Random(8)
    powers = substrings._powers(substrings._BASE, 512)
    for i in range(300):
        size, kinds = rng.choice([51, 51, 60]), rng.choice([1, 2, 3, 5, 1000])
        some = lambda n: [f"w{rng.randrange(kinds)}" for _ in range(n)]  # noqa: B023, E731
        passage = some(size)
        texts = [[*some(a), *passage, *some(rng.randrange(60))] for a in (i % 60, 7)]
        found = []
        for text in texts:
            words = words_hash(text)
            cuts = substrings.inner_cuts(words, ends(words), 51)[0]
            found.append(substrings.contents(words, cuts[:-1], cuts[1:], powers))
        known = np.intersect1d(*found)
        for text, at in zip(texts, (i % 60, 7)):
            assert set(range(at, at + size - 50)) <= set(substrings.candidate_stretches(words_hash(text), np.array([0, len(text)]), known, powers, 51).tolist())


def brute(docs, size):
    """Passages of rows (id, text) by plain comparison: all stretches of words, and all lines in pairs."""
    texts = {key: [line.split() for line in text.lower().split("\n") if line.split()] for key, text in docs if key is not None and text}
    words = {key: [w for line in lines for w in line] for key, lines in texts.items()}
    first = {}
    for key in sorted(words):
        for i in range(len(words[key]) - size + 1):
            first.setdefault(tuple(words[key][i : i + size]), key)
    lines = [(key, sum(map(len, ls[:i])), line) for key, ls in texts.items() for i, line in enumerate(ls) if len(line) >= max(5, 0.8 * size)]
    kinds = sorted({tuple(line) for *_, line in lines})
    sets = [{line[i : i + 5] for i in range(len(line) - 4)} for line in kinds]
    parent = list(range(len(kinds)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(kinds)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    root = {line: find(i) for i, line in enumerate(kinds)}
    keeper = {}
    for key, _, line in lines:
        keeper[root[tuple(line)]] = min(key, keeper.get(root[tuple(line)], key))
    out = set()
    for key, own in words.items():
        runs = []
        for i in range(len(own) - size + 1):
            kept = first[tuple(own[i : i + size])]
            if kept < key:
                runs.append((i, i + size, kept))
        whole = [k for k in sorted(words) if words[k] == own and k < key]
        if whole:
            if len(own) >= size:
                out.add((key, 0, len(own), whole[0]))
            continue
        sure = []
        for start, stop, kept in runs:
            if sure and start <= sure[-1][1]:
                sure[-1] = (sure[-1][0], stop, min(kept, sure[-1][2]))
            else:
                sure.append((start, stop, kept))
        for keeping in set(keeper.values()):
            on_end = []
            for other, start, line in sorted((x for x in lines if x[0] == key), key=lambda x: x[1]):
                if keeper[root[tuple(line)]] == keeping < key:
                    if on_end and start <= on_end[-1][1]:
                        on_end[-1] = (on_end[-1][0], start + len(line), keeping)
                    else:
                        on_end.append((start, start + len(line), keeping))
            sure += [x for x in on_end if x[1] - x[0] >= size]
        runs = []
        for start, stop, kept in sorted(sure):
            if runs and start < runs[-1][1]:
                runs[-1] = (runs[-1][0], max(stop, runs[-1][1]), min(kept, runs[-1][2]))
            else:
                runs.append((start, stop, kept))
        out |= {(key, start, stop - start, kept) for start, stop, kept in runs}
    return out


def small_corpus(seed, kinds, size):
    rng = random.Random(seed)
    some = lambda n: [f"w{rng.randrange(kinds)}" for _ in range(n)]
    shared = [some(rng.randrange(size // 2, 3 * size)) for _ in range(6)]
    docs = []
    for i in range(40):
        words = []
        for _ in range(rng.randrange(4)):
            words += some(rng.randrange(2 * size)) + rng.choice(shared)[rng.randrange(3) :]
        lay = rng.choice([[" "], [" ", " ", " ", " ", " ", "\n"], [" ", "\n", " \n\n"]])
        docs.append((i * 7 % 40, "".join(w + rng.choice(lay) for w in words)))
    return [*docs, (100, docs[3][1]), (101, docs[3][1].upper().replace(" ", "\t")), (102, ""), (103, "one")]


@pytest.mark.parametrize("kinds, size", [(1, 12), (2, 12), (3, 12), (3, 51), (50, 12), (50, 51), (5000, 20)])
def test_equals_brute_force(spark, kinds, size):
    docs = small_corpus(kinds + size, kinds, size)
    rows = substrings.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string"), passage_words=size).collect()
    assert {(r.id, r.start, r.n, r.kept) for r in rows} == brute(docs, size)


def test_query_finds_what_all_stretches_of_the_table_have_in_common(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert {tuple(r) for r in substrings.op6_substring_dedup(spark, sf_dir).collect()} == brute(docs, 51)


def test_nothing_is_found_without_bands(spark, monkeypatch):
    docs, planted = corpus()
    rng = random.Random(1)
    strange = lambda shingles, starts, stops, count=4, rows=2: np.array([[rng.getrandbits(64) for _ in range(count)] for _ in starts], np.uint64).reshape(-1, count)
    words = [substrings.words_of([t.encode()]) for _, t in docs[:3]]
    monkeypatch.setattr(substrings, "bands", strange)
    keys = [substrings.paragraphs(*w, substrings._powers(substrings._BASE, 1000), 51) for w in words]
    shared = set.intersection(*({int(k) for k, kind, n in zip(x[5][:, 0], x[1], x[3]) if kind == substrings.INNER and n >= 5} for x in keys))
    assert not shared and planted


@pytest.mark.parametrize("cell", [3, 512])
def test_similar_lines_are_repeated(spark, monkeypatch, cell):
    monkeypatch.setattr(substrings, "CELL", cell)
    rng = random.Random(7)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 40):
        words = list(base)
        for _ in range(rng.randrange(1, 4)):
            words[rng.randrange(120)] = f"edit{i}"
        rows.append((i, f"Own line {i}\n" + " ".join(words)))
    found = {(r.id, r.start, r.n, r.kept) for r in substrings.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == brute(rows, 51) and len(found) >= 30


def test_links_against_the_first_and_the_rest(spark, monkeypatch):
    """Buckets in which the first content is like some, all or none of the others."""
    monkeypatch.setattr(substrings, "CELL", 4)
    rng = random.Random(11)
    rows, lines = [], {}
    for key in range(12):
        bases = [[f"k{key}b{b}w{i}" for i in range(60)] for b in range(1 + key % 3)]
        for _ in range(rng.choice([1, 2, 3, 9])):
            words = list(rng.choice(bases))
            for _ in range(rng.randrange(3)):
                words[rng.randrange(60)] = f"e{rng.randrange(10**6)}"
            lines[" ".join(words)] = key
    texts = list(lines)
    powers = substrings._powers(substrings._BASE, 100)
    names = [int(substrings.contents(words_hash(t.split()), np.array([0]), np.array([60]), powers).view(np.int64)[0]) for t in texts]
    rows = [(i, i * 10, t.encode()) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "id long, text_hash long, text binary")
    keyed = spark.createDataFrame([(lines[t], names[i], (i, i * 10, 0, 60)) for i, t in enumerate(texts)], "key long, c long, at struct<id:long,text_hash:long,start:int,n:int>")
    at = {c: i for i, c in enumerate(names)}
    linked = [(at[r.u], at[r.v]) for r in substrings._line_links(table, keyed).collect()]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(56)} for t in texts]
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    assert all(alike(a, b) for a, b in linked)
    small = {k for k in range(12) if sum(lines[t] == k for t in texts) <= 4}

    def roots(pairs):
        parent = list(range(len(texts)))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            parent[find(a)] = find(b)
        return [find(i) for i in range(len(texts)) if lines[texts[i]] in small]

    wanted = [(a, b) for a in range(len(texts)) for b in range(a) if lines[texts[a]] == lines[texts[b]] and alike(a, b)]
    mine, theirs = roots(linked), roots(wanted)
    assert len(set(zip(mine, theirs))) == len(set(mine)) == len(set(theirs))


def test_texts_of_one_id_are_kept_apart(spark):
    rng = random.Random(14)
    one, two = (" ".join(f"{x}{rng.randrange(10**6)}" for _ in range(120)) for x in "ab")
    rows = [(0, one), (1, one), (1, "short"), (1, two + " tail"), (2, two), (2, None), (None, one), (3, "x\n" + one), (3, "x\n" + one)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.id, r.start, r.n, r.kept) for r in substrings.repeated_passages(df).collect()} == {(1, 0, 120, 0), (2, 0, 120, 1), (3, 1, 120, 0)}
    left = sorted(map(tuple, substrings.remove_passages(df).collect()), key=str)
    assert left == sorted([(0, one), (1, "short"), (1, two + " tail"), (2, None), (None, one), (3, "x"), (3, "x")], key=str)


def test_very_long_texts(spark):
    rng = random.Random(15)
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(80))
    far = " ".join(f"w{rng.randrange(10**6)}" for _ in range(250_000))
    rows = [(1, far + " " + passage + " la" * 200_000), (2, "start " + passage), (3, "la " * 60)]
    found = {(r.id, r.start, r.n, r.kept) for r in substrings.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {(2, 1, 80, 1), (3, 0, 60, 1)}


def test_removal_and_edges(spark):
    docs, _ = corpus()
    whole = docs[0][1]
    rows = [*docs, (9000, whole), (9001, whole), (9001, whole), (9002, None), (9003, ""), (9004, " \n "), (9005, "one"), (None, whole), (9006, "again and " * 300)]
    df = spark.createDataFrame([(k, t, len(t or ""), "x", 1) for k, t in rows], "doc_id long, text string, n_chars long, id string, start int")
    spans = {}
    for r in substrings.repeated_passages(df).collect():
        spans.setdefault(r.id, []).append((r.start, r.n))
    assert 9000 in spans and 9001 in spans and not {9002, 9003, 9004, 9005, 9006, None} & set(spans)
    left = substrings.remove_passages(df)
    assert left.columns == df.columns
    kept = left.collect()
    ids = [r.doc_id for r in kept]
    assert 9000 not in ids and 9001 not in ids and {9002, 9003, 9004, 9005, 9006, None} <= set(ids)
    texts = dict(docs)
    for r in kept:
        if r.doc_id in texts:
            words = texts[r.doc_id].split()
            gone = {i for s, n in spans.get(r.doc_id, []) for i in range(s, s + n)}
            assert r.text.split() == [w for i, w in enumerate(words) if i not in gone] and r.n_chars == len(r.text)
    assert substrings.repeated_passages(df.limit(0)).count() == 0


def test_without_words():
    assert substrings.without_words(b" a  b c\nd ", [1], [2]) == b" a\nd "
    assert substrings.without_words(b" a  b c\nd ", [0, 3], [2, 1]) == b" c "
    assert substrings.without_words(b"a b", [0], [2]) == b""


def test_links_do_not_depend_on_the_size_of_a_bucket(spark, monkeypatch):
    """Pairs of lines with a similarity of just 0.8, all in one large bucket: each pair is linked, as in a small one."""
    monkeypatch.setattr(substrings, "CELL", 20)
    rng = random.Random(5)
    texts = []
    for pair in range(1200):
        base = [f"p{pair}w{i}" for i in range(74)] + [f"common{i}" for i in range(20)]
        edited = list(base)
        for at in (15, 55):  # 10 of 90 shingles differ: 80 of 100 are alike
            edited[at] = f"e{rng.randrange(10**9)}"
        texts += [" ".join(base), " ".join(edited)]
    powers = substrings._powers(substrings._BASE, 200)
    names = [int(substrings.contents(words_hash(t.split()), np.array([0]), np.array([94]), powers).view(np.int64)[0]) for t in texts]
    table = spark.createDataFrame([(i, i * 10, t.encode()) for i, t in enumerate(texts)], "id long, text_hash long, text binary")
    kind = "key long, c long, at struct<id:long,text_hash:long,start:int,n:int>"
    keyed = spark.createDataFrame([(1, names[i], (i, i * 10, 0, 94)) for i in range(len(texts))], kind)
    wanted = {frozenset(names[i : i + 2]) for i in range(0, len(texts), 2)}
    assert {frozenset((r.u, r.v)) for r in substrings._line_links(table, keyed).collect()} == wanted


def test_cuts_take_little_memory_and_stay_the_same(monkeypatch):
    rng = np.random.default_rng(8)
    words = rng.integers(0, 3000, 200_000).astype(np.uint64)
    texts = np.array([0, 70_000, 70_030, len(words)])
    tracemalloc.start()
    cuts, chosen = substrings.inner_cuts(words, texts, 51)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 12 * words.nbytes  # a copy of all shingles for each place that may choose them has 23 times as much
    for copied in (1, 23 * 7, 1 << 40):
        monkeypatch.setattr(substrings, "COPIED", copied)
        few = words[:5000] if copied == 1 else words
        ends = np.array([0, 100, len(few)]) if copied == 1 else texts
        found = substrings.inner_cuts(few, ends, 51)
        if copied > 1:
            assert (found[0] == cuts).all() and (found[1] == chosen).all()
        else:
            assert (found[1][200:4900] == chosen[200:4900]).all()


def test_removal_calls_python_once(spark):
    shared = " ".join(f"p{i}" for i in range(80))
    docs = spark.createDataFrame([(1, "one\n" + shared), (2, "two\n" + shared), (3, shared), (4, "four"), (5, None)], "doc_id long, text string")
    out = substrings.remove_passages(docs)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1  # one worker for each task, not two
    assert sorted(map(tuple, out.collect())) == [(1, "one\n" + shared), (2, "two"), (4, "four"), (5, None)]
