"""Substring dedup: repeated passages, found by MinHash bands of paragraphs, verified, and clustered by components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_broadcast, drop_written, hot_join, small_batches, table, temporary, utf8, written
from .components import connected_components

SHINGLE_WORDS, SIMILARITY = 5, 0.8
#: Lines collide if both rows of one of these bands agree: of those with similarity 0.8, 98 in 100 do.
BANDS, ROWS = 4, 2
#: Inner paragraphs collide if all rows of their one band agree: equal ones always do.
INNER_ROWS = 4
#: Passages have at least so many words.
PASSAGE_WORDS = 51
#: Lines of a bucket that are compared with each other at once.
CELL = 512
#: Shingles that are copied at once where the least of each so many on end is chosen.
COPIED = 1 << 17
#: What a paragraph is: a whole text, a line of it, or a part of it between two places that its words choose.
WHOLE, LINE, INNER = 0, 1, 2
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_FACTORS = np.array([(0xBF58476D1CE4E5B9 * (2 * i + 1) + 2 * i) & 0xFFFFFFFFFFFFFFFF | 1 for i in range(BANDS * ROWS)], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD
    return x ^ (x >> np.uint64(29))


def _powers(base: int, count: int) -> np.ndarray:
    out = np.ones(count, np.uint64)
    if count > 1:
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of texts on end, and the words at which lines with words and texts begin, the end included.

    Words are runs without ASCII white space; A-Z are lower-cased.
    """
    digest = xxhash.xxh3_64_intdigest
    words: list[bytes] = []
    lines, starts = [], []
    for text in texts:
        starts.append(len(words))
        for line in text.lower().split(b"\n"):
            own = line.split()
            if own:
                lines.append(len(words))
                words += own
    hashes = np.fromiter(map(digest, words), np.uint64, len(words))
    return hashes, np.array([*lines, len(words)], np.int64), np.array([*starts, len(words)], np.int64)


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """A hash of each five words on end; of all words if there are fewer; none without words."""
    if not len(words):
        return words
    size = min(SHINGLE_WORDS, len(words))
    out = words[: len(words) - size + 1].copy()
    for i in range(1, size):
        out = out * np.uint64(_BASE) + words[i : len(words) - size + 1 + i]
    return _mixed(out)


def reach(passage_words: int) -> int:
    """Shingles among which a place is chosen: a passage has twice as many."""
    return max((passage_words - SHINGLE_WORDS + 1) // 2, 1)


def inner_cuts(words: np.ndarray, texts: np.ndarray, passage_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Where inner paragraphs begin, the end included, and the place chosen at each word, of texts on end that begin at the
    words ``texts`` (the end included).

    The place chosen at a word is that of the last shingle with the least hash among so many that begin there (-1 where
    the text ends before); places and texts' beginnings are cuts. A choice depends on these shingles alone, whatever words
    they are, so each passage of ``passage_words`` words has two chosen places, and what lies between them is cut alike
    wherever it stands.
    """
    many = reach(passage_words)
    chosen = np.full(len(words), -1, np.int64)
    count = len(words) - (many + SHINGLE_WORDS - 1) + 1
    if count > 0:
        seen = np.lib.stride_tricks.sliding_window_view(shingle_hashes(words), many)
        step = max(COPIED // many, 1)
        for at in range(0, count, step):  # argmin copies all that it is given, each shingle as often as places may choose it
            some = seen[at : at + step, ::-1]
            chosen[at : at + len(some)] = np.arange(at, at + len(some)) + many - 1 - some.argmin(axis=1)
        for stop in texts[1:-1]:  # stretches over the end of a text choose nothing
            chosen[max(stop - (many + SHINGLE_WORDS - 1) + 1, 0) : stop] = -1
    begins = texts[:-1][np.diff(texts) > 0]
    return np.append(np.unique(np.concatenate((begins, chosen[chosen >= 0]))), len(words)), chosen


def contents(words: np.ndarray, starts: np.ndarray, stops: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """A hash of the words of each range, equal for equal words wherever they stand.

    ``powers`` are those of ``_BASE``; the hash is a polynomial in it, by Horner's rule from a running sum.
    """
    inverse = pow(_BASE, -1, 1 << 64)
    back = _powers(inverse, len(words) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mixed(words) * powers[: len(words)], dtype=np.uint64)))
    return _mixed((sums[stops] - sums[starts]) * back[starts] + (stops - starts).astype(np.uint64) * _ODD)


def bands(shingles: np.ndarray, starts: np.ndarray, stops: np.ndarray, count: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """The ``count`` band keys of paragraphs whose shingles are ``shingles[start:stop]``: one row each.

    A band's key is a hash of the least values that ``rows`` hash functions give to the paragraph's shingles.
    """
    ranges = np.column_stack((starts, stops)).ravel()
    ranges = ranges[:-1] if len(ranges) and ranges[-1] == len(shingles) else ranges
    keys = np.empty((len(starts), count), np.uint64)
    for band in range(count if len(starts) else 0):
        key = np.full(len(starts), band + 1 + 64 * rows, np.uint64)
        for row in range(rows):
            found = _mixed(shingles * _FACTORS[band * rows + row])
            key = _mixed(key * np.uint64(_BASE) + np.minimum.reduceat(found, ranges)[::2])
        keys[:, band] = key
    return keys


def paragraphs(words: np.ndarray, lines: np.ndarray, texts: np.ndarray, powers: np.ndarray, passage_words: int) -> tuple[np.ndarray, ...]:
    """(text, kind, start, n, content, bands) of the paragraphs of texts on end, text by text; of ``bands``, ``BANDS`` keys count
    for lines and one for inner paragraphs. The first word is counted from the text's first.

    These are each whole text that has words, each line that may be similar to a passage (it has at least 0.8 times the
    words), and each content that stands between two cuts of a text, once. The band of an inner paragraph below five
    words is its content's hash.
    """
    cuts, _ = inner_cuts(words, texts, passage_words)
    full = np.flatnonzero(np.diff(texts) > 0)
    long = np.flatnonzero(np.diff(lines) >= max(SHINGLE_WORDS, SIMILARITY * passage_words))
    starts = np.concatenate((texts[:-1][full], lines[:-1][long], cuts[:-1]))
    stops = np.concatenate((texts[1:][full], lines[1:][long], cuts[1:]))
    kinds = np.repeat([WHOLE, LINE, INNER], [len(full), len(long), len(cuts) - 1])
    found = contents(words, starts, stops, powers)
    owner = np.searchsorted(texts, starts, "right") - 1
    order = np.lexsort((found, kinds, owner))
    again = np.zeros(len(order), bool)
    again[1:] = (found[order][1:] == found[order][:-1]) & (owner[order][1:] == owner[order][:-1]) & (kinds[order][1:] == INNER) & (kinds[order][:-1] == INNER)
    stay = np.sort(order[~again])
    stay = stay[np.argsort(owner[stay], kind="stable")]
    owner, kinds, starts, stops, found = owner[stay], kinds[stay], starts[stay], stops[stay], found[stay]
    keys = np.zeros((len(stay), BANDS), np.uint64)
    shingles = shingle_hashes(words)
    own = np.flatnonzero(kinds == LINE)
    keys[own] = bands(shingles, starts[own], stops[own] - SHINGLE_WORDS + 1)
    own = np.flatnonzero(kinds == INNER)
    keys[own, 0] = _mixed(found[own] ^ _ODD)
    own = own[stops[own] - starts[own] >= SHINGLE_WORDS]
    keys[own, :1] = bands(shingles, starts[own], stops[own] - SHINGLE_WORDS + 1, 1, INNER_ROWS)
    return owner, kinds, starts - texts[owner], stops - starts, found, keys


_TEXT_HASH = "text_hash"


def _texts(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Rows (id, text_hash, text) of the documents that have an id."""
    rows = docs.where(F.col(id_column).isNotNull())
    return rows.select(F.col(id_column).alias("id"), F.xxhash64(text_column).alias(_TEXT_HASH), utf8(text_column).alias("text"))


def units(texts: DataFrame, passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """Rows (id, text_hash, kind, start, n, c, bands) of the paragraphs of rows (id, text_hash, text): first word, number of
    words, a hash of the words, and band keys (none of whole texts).

    Texts without words have none. Repeated rows give theirs each; an empty table gives an empty result.
    """
    small_batches(texts.sparkSession)
    names = ["id", _TEXT_HASH, "kind", "start", "n", "c", "bands"]
    widths = np.array([0, BANDS, 1])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _powers(_BASE, 1 << 16)
        for batch in batches:
            words, lines, begins = words_of(batch.column(2).to_pylist())
            if not len(words):
                continue
            if len(words) > len(powers):
                powers = _powers(_BASE, 2 * len(words))
            where, kinds, starts, sizes, hashes, keys = paragraphs(words, lines, begins, powers, passage_words)
            width = widths[kinds]
            flat = keys[np.arange(BANDS) < width[:, None]].view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(width))).astype(np.int32)), pa.array(flat))
            rows = pa.array(where)
            found = [pa.array(kinds.astype(np.int8)), pa.array(starts.astype(np.int32)), pa.array(sizes.astype(np.int32)), pa.array(hashes.view(np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *found, lists], names=names)

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(run, f"id {kind}, {_TEXT_HASH} long, kind tinyint, start int, n int, c long, bands array<long>")


def shingle_sets(texts: DataFrame, places: DataFrame) -> DataFrame:
    """Rows (c, shingles): the distinct shingle hashes of the lines at ``places``, rows (id, text_hash, lines) with an array of
    (c, start, n) for each text."""
    chosen = texts.join(bounded_broadcast(places.select("id", _TEXT_HASH)), ["id", _TEXT_HASH], "left_semi").join(places, ["id", _TEXT_HASH])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sets = [], []
            words, _, begins = words_of(batch.column(1).to_pylist())
            for lines, begin in zip(batch.column(0).to_pylist(), begins.tolist()):
                for line in lines:
                    at = begin + line["start"]
                    names.append(line["c"])
                    sets.append(np.unique(shingle_hashes(words[at : at + line["n"]])).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["c", "shingles"])

    # Texts that repeat with one id give a content more than once.
    return chosen.select("lines", "text").mapInArrow(run, "c long, shingles array<long>").dropDuplicates(["c"])


def shared_prefixes(keyed: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows (key, c, odd): finer buckets of rows (key, c, odd), in which every two similar contents of a bucket meet again.

    A content is in a finer bucket for each of the rarest of its shingles, rarest in the bucket first. Of n shingles, two similar
    contents share at least 0.8 n, for the n of either; so the first n - ceil(0.8 n) + 1 in any one order, which miss fewer
    than 0.8 n, have one in common. Finer buckets of one content, and those without an odd one, are left out.
    """
    rows = keyed.join(sets, "c").select("key", "c", "odd", F.explode("shingles").alias("shingle"))
    rows = written(rows.select(F.xxhash64("key", "shingle").alias("fine"), "key", "c", "odd"), "line-elements")
    rare = written(rows.groupBy("fine").agg(F.count("*").alias("often")).withColumn("many", F.col("often")), "line-rare")
    rows = hot_join(rows, rare, "fine").groupBy("key", "c", "odd").agg(F.sort_array(F.collect_list(F.struct("often", "fine"))).alias("ordered"))
    size = F.size("ordered")
    first = F.slice("ordered", F.lit(1), size - F.ceil(size * SIMILARITY - 1e-9).cast("int") + 1)
    finer = rows.select("c", "odd", F.explode(first).alias("at")).where("at.often > 1").select(F.col("at.fine").alias("key"), "c", "odd")
    finer = written(finer, "line-prefixes")
    wanted = finer.groupBy("key").agg(F.count("*").alias("many"), F.bool_or("odd").alias("wanted")).where("wanted AND many > 1").select("key", "many")
    return written(hot_join(finer, written(wanted, "line-finer"), "key", "left_semi"), "line-fine")


def _is_similar(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return shared >= SIMILARITY * (F.size(a) + F.size(b) - shared)


def against_first(keyed: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows (key, c, first, n, similar): each content of a bucket, of rows (key, c), against the bucket's first one.

    So there are no more comparisons than rows. The first one comes once for each ``CELL`` contents of the bucket, so that
    no task meets a whole large bucket.
    """
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("c").alias("first")).where("n > 1")
    parts = F.ceil(F.col("n") / CELL).cast("int")
    sizes = written(sizes.withColumn("many", F.col("n")), "bucket-sizes")
    others = hot_join(keyed, sizes, "key").where("c <> first").withColumn("part", F.pmod(F.xxhash64("c"), parts).cast("int"))
    firsts = sizes.select("first", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part")).distinct()
    held = sets.select("c", "shingles")
    firsts = firsts.join(held.withColumnRenamed("c", "first").withColumnRenamed("shingles", "__first"), "first")
    both = others.join(held, "c").join(firsts, ["first", "part"])
    return both.select("key", "c", "first", "n", _is_similar(F.col("shingles"), F.col("__first")).alias("similar"))


def similar_links(odd: list[bool], sets: list[np.ndarray], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links (positions) of sets (sorted arrays): from each odd one to every similar odd one that is not reached yet, and to
    one similar one that is not odd.

    Those that are not odd are known to be linked with each other, so the links connect exactly what all pairs with a
    Jaccard similarity of at least ``similarity`` would.
    """
    members = [frozenset(x.tolist()) for x in sets]

    def alike(a: int, b: int) -> bool:
        small, large = sorted((len(members[a]), len(members[b])))
        shared = len(members[a] & members[b]) if small >= similarity * large else 0
        return shared > 0 and shared >= similarity * (small + large - shared)

    links, todo = [], [i for i, x in enumerate(odd) if x]
    others = [i for i, x in enumerate(odd) if not x]
    while todo:
        queue = [todo.pop()]
        while queue:
            at = queue.pop()
            near = {x for x in todo if alike(at, x)}
            links += [(at, x) for x in sorted(near)]
            queue += sorted(near)
            todo = [x for x in todo if x not in near]
            one = next((x for x in others if alike(at, x)), None)
            links += [(at, one)] if one is not None else []
    return links


def _cell_links(keyed: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows (u, v): links between the contents of buckets, of rows (key, c, odd), but for those between two that are not odd.

    Odd contents are compared with all contents of their bucket: those of each ``CELL`` odd ones with each ``CELL`` others
    in a task's turn.
    """
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.count_if("odd").alias("odds")).where("odds > 0 AND n > 1")
    sized = keyed.join(bounded_broadcast(sizes), "key")
    parts = {name: F.ceil(F.col(name) / CELL).cast("int") for name in ("odds", "n")}
    mine = {name: F.pmod(F.xxhash64("c"), part).cast("int") for name, part in parts.items()}
    every = {name: F.sequence(F.lit(0), part - 1) for name, part in parts.items()}
    # Cell (a, b) has the odd ones of part a of the odd, and all contents of part b; a content may be there for both.
    as_odd = F.when(F.col("odd"), F.transform(every["n"], lambda b: F.struct(mine["odds"].alias("a"), b.alias("b"))))
    as_any = F.transform(every["odds"], lambda a: F.struct(a.alias("a"), mine["n"].alias("b")))
    places = F.array_distinct(F.concat(F.coalesce(as_odd, F.array().cast("array<struct<a:int,b:int>>")), as_any))
    dealt = sized.select("key", "c", "odd", F.explode(places).alias("at")).select("key", "at.a", "at.b", "c", "odd")
    ready = dealt.join(sets.select("c", "shingles"), "c").select("key", "a", "b", "c", "odd", "shingles")
    ready = ready.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "c")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, odd, sets = None, [], [], []

        def out() -> Iterator[pa.RecordBatch]:
            links = similar_links(odd, sets)
            if links:
                pairs = np.array(names, np.int64)[np.array(links)]
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

        for batch in batches:
            key, a, b, c = (batch.column(i).to_numpy() for i in range(4))
            values, ends = batch.column(5).flatten().to_numpy(), batch.column(5).offsets.to_numpy()
            ends = ends - ends[0] if len(ends) else ends
            for i, is_odd in enumerate(batch.column(4).to_pylist()):
                if now != (this := (key[i], a[i], b[i])):
                    yield from out()
                    now, names, odd, sets = this, [], [], []
                names.append(int(c[i]))
                odd.append(is_odd)
                sets.append(values[ends[i] : ends[i + 1]])
        yield from out()

    return ready.mapInArrow(run, "u long, v long")


def _line_links(texts: DataFrame, keyed: DataFrame) -> DataFrame:
    """Rows (u, v) that connect the contents of lines that share a band and are similar, of rows (key, c, at): buckets of
    several contents, each with a place (id, text_hash, start, n).

    Each content is compared with its bucket's first one, which settles buckets of one kind of line, however large. What
    is not similar to it is then compared with the whole bucket, or, if that is large, in finer buckets that lose no two
    similar ones, with their first one and the rest in the same way. So links connect what all pairs of a bucket would.
    """
    places = keyed.groupBy("c").agg(F.min("at").alias("at")).groupBy("at.id", f"at.{_TEXT_HASH}")
    places = written(places.agg(F.collect_list(F.struct("c", "at.start", "at.n")).alias("lines")), "line-places")
    sets = written(shingle_sets(texts, places), "line-shingles")
    links, left = _beside_first(keyed.select("key", "c"), sets)
    if left.limit(1).count():
        small = left.where(F.col("n") <= CELL).select("key", "c", "odd")
        large = left.where(F.col("n") > CELL).select("key", "c", "odd")
        if large.limit(1).count():
            more, rest = _beside_first(shared_prefixes(large, sets).select("key", "c"), sets)
            links, small = links.union(more), small.union(rest.select("key", "c", "odd"))
        links = links.union(_cell_links(small, sets))
    return links.distinct()


def _beside_first(pairs: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (u, v) between the first content of each bucket, of rows (key, c), and what is similar to it; and the rows (key, c, n,
    odd) of those buckets that hold something else, which is odd."""
    checked = written(against_first(pairs, sets), "line-checks")
    links = checked.where("similar").select(F.col("c").alias("u"), F.col("first").alias("v"))
    open_keys = checked.where("n > 2").groupBy("key").agg(F.max("n").alias("n"), F.bool_and("similar").alias("settled")).where("NOT settled").select("key", "n")
    odd = checked.where("NOT similar").select("key", "c", F.lit(True).alias("odd"))
    left = pairs.join(bounded_broadcast(open_keys), "key").join(odd, ["key", "c"], "left").withColumn("odd", F.coalesce("odd", F.lit(False)))
    return links, written(left, "line-rest")


def repeated_passages(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", passage_words: int = PASSAGE_WORDS
) -> DataFrame:
    """Rows (id, text_hash, start, n, kept): passages, as first word and number of words, that an earlier document also has.

    Paragraphs are lines of at least 0.8 times ``passage_words`` words and, as a passage may stand inside a line or cover short
    ones, what lies between two places that a text's words choose; each passage of ``passage_words`` words has such an
    inner paragraph whole. Paragraphs that share a MinHash band are
    joined. Lines are similar if the exact Jaccard similarity of their shingles of five words is at least 0.8, and the
    components of these links are classes; a line of a class of which a document with a smaller id also has one is
    repeated. Inner paragraphs count if they are equal: all stretches of ``passage_words`` words with none but repeated
    inner paragraphs are compared, and are repeated if a document with a smaller id has the same words. Passages are what
    repeated stretches cover together, and repeated lines on end, kept by one document, of ``passage_words`` words
    together; those that overlap are one. ``kept`` is the smallest id that has a part of it. A text whose words another
    document with a smaller id has, all of them and no others, is one passage.

    Documents without words have no passage, nor do rows with a null id, and they keep none. Texts are whole, however long.
    Rows that repeat an id with other texts are told apart by ``text_hash`` (XXH64 of the text), but repetition within one
    id does not count; rows alike in id and text have one list of passages. Other columns are ignored; an empty table gives
    an empty result.
    """
    small_batches(docs.sparkSession)
    texts = _texts(docs, id_column, text_column)
    key = ["id", _TEXT_HASH]
    with temporary() as keep:
        found = written(units(texts, passage_words), "units")
        whole = found.where(F.col("kind") == WHOLE)
        equal = whole.groupBy("c", "n").agg(F.min("id").alias("kept"), F.max("id").alias("last"), F.count("*").alias("many"))
        equal = written(equal.where("kept < last").select("c", F.col("n").alias("words"), "kept", "many"), "equal-texts")
        copies = written(hot_join(whole, equal, "c").where("id > kept AND n = words").select(*key, "n", "kept").distinct(), "copies")

        inner = found.where(F.col("kind") == INNER).select(*key, "kind", "c", F.get("bands", F.lit(0)).alias("key"))
        line = found.where(F.col("kind") == LINE)
        banded = line.select(*key, "kind", "start", "n", "c", F.explode("bands").alias("key"))
        parts = inner.select("key", "kind", "id", "c").union(banded.select("key", "kind", "id", "c"))
        spread = parts.groupBy("key").agg(
            F.min("id").alias("low"), F.max("id").alias("high"), F.min("c").alias("least"), F.max("c").alias("most"), F.max("kind").alias("kind"), F.count("*").alias("many")
        )
        buckets = written(spread.where("low < high OR least < most"), "buckets")
        of_lines = buckets.where(F.col("kind") == LINE)
        several = hot_join(banded, of_lines.where("least < most").select("key", "many"), "key")
        at = F.min(F.struct(*key, "start", "n")).alias("at")
        several = written(several.groupBy("key", "c").agg(at, F.max("id").alias("last"), F.count("*").alias("many")), "bucket-contents")

        with temporary() as hold:  # the shingles of the lines go as soon as they are compared
            links = hold(written(_line_links(texts, several.select("key", "c", "at")), "line-links"))
        classes = written(connected_components(links).select(F.col("node").alias("c"), F.col("component").alias("class")), "line-classes")
        # What one document alone has matters only if it is similar to what another one has.
        alone = of_lines.where("least = most").select(F.col("least").alias("c"), "low", "high", "many", F.lit(False).alias("linked"))
        beside = several.select("c", F.col("at.id").alias("low"), F.col("last").alias("high"), "many", F.lit(False).alias("linked"))
        in_class = classes.select("c", F.lit(None).alias("low"), F.lit(None).alias("high"), F.lit(0).alias("many"), F.lit(True).alias("linked"))
        wanted = alone.union(beside).union(in_class).groupBy("c")
        wanted = wanted.agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("many").alias("many"), F.bool_or("linked").alias("linked"))
        wanted = written(wanted.where("linked OR low < high").select("c", "many"), "wanted-lines")
        gone = bounded_broadcast(copies.select(*key))
        members = hot_join(line.select(*key, "start", "n", "c"), wanted, "c", "left_semi")
        members = written(members.join(gone, key, "left_anti"), "repeated-lines")
        held = members.groupBy("c").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("many")).join(classes, "c", "left")
        held = written(held.where("class IS NOT NULL OR low < high"), "repeated-contents")
        linked = held.where("class IS NOT NULL")
        first = linked.groupBy("class").agg(F.min("low").alias("kept"), F.max("high").alias("last")).where("kept < last").select("class", "kept")
        named = held.where("class IS NULL").select("c", F.col("low").alias("kept"), "many")
        named = written(named.union(linked.join(first, "class").select("c", "kept", "many")), "kept-lines")
        lines = hot_join(members, named, "c").where("id > kept")
        lines = lines.select(*key, "start", "n", "kept", F.lit(False).alias("sure"))
        shared = buckets.where(F.col("kind") == INNER).where("low < high").select("key", "many")
        known = hot_join(inner.select(*key, "c", "key"), shared, "key", "left_semi").select(*key, "c")
        known = known.join(gone, key, "left_anti")
        lists = written(known.groupBy(*key).agg(F.collect_set("c").alias("known")), "known-units")
        for spent in (found, equal, buckets, several, wanted):  # nothing reads these from here on
            drop_written(spent)
        stretches = _repeated_stretches(texts, lists, passage_words)

        rows = lines.union(stretches).repartition(*key).sortWithinPartitions(*key, "start", F.desc("n"), "kept")
        kind = texts.schema["id"].dataType.simpleString()
        merged = rows.mapInArrow(lambda batches: _merge(batches, passage_words), f"id {kind}, {_TEXT_HASH} long, start int, n int, kept {kind}")
        entire = copies.where(F.col("n") >= passage_words).select(*key, F.lit(0).alias("start"), "n", "kept")
        return keep(written(merged.union(entire), "passages"))


def candidate_stretches(words: np.ndarray, texts: np.ndarray, known: np.ndarray, powers: np.ndarray, size: int) -> np.ndarray:
    """Where, in texts on end that begin at the words ``texts`` (the end included), the stretches of ``size`` words begin that
    may stand in another document: those whose inner paragraphs, as far as the stretch alone decides on their bounds, are
    all among the contents ``known`` to be repeated."""
    cuts, chosen = inner_cuts(words, texts, size)
    strange = np.concatenate(([0], np.cumsum(~np.isin(contents(words, cuts[:-1], cuts[1:], powers), known))))
    last_of = size - SHINGLE_WORDS + 1 - reach(size)
    # A place is chosen at a stretch's first word and at the last one from which on it decides alone.
    starts = np.flatnonzero((chosen[: len(chosen) - last_of] >= 0) & (chosen[last_of:] >= 0)) if len(chosen) > last_of else np.empty(0, np.int64)
    starts = starts[np.searchsorted(texts, starts, "right") == np.searchsorted(texts, starts + size - 1, "right")]
    first, last = (np.searchsorted(cuts, chosen[starts + at]) for at in (0, last_of))
    return starts[strange[first] == strange[last]]


def _repeated_stretches(texts: DataFrame, lists: DataFrame, size: int) -> DataFrame:
    """Rows (id, text_hash, start, n, kept, sure): each ``size`` words on end that a document with a smaller id has, too, and
    the smallest such id. ``lists`` are rows (id, text_hash, known) with the inner paragraphs whose band another document shares."""
    key = ["id", _TEXT_HASH]
    chosen = texts.join(bounded_broadcast(lists.select(*key)), key, "left_semi").join(lists, key).select(*key, "known", "text")
    kind = texts.schema["id"].dataType.simpleString()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _powers(_BASE, 1 << 16)
        for batch in batches:
            words, _, begins = words_of(batch.column(3).to_pylist())
            if len(words) > len(powers):
                powers = _powers(_BASE, 2 * len(words))
            # What is repeated across documents is so in whatever text it stands.
            repeated = np.unique(batch.column(2).flatten().to_numpy()).view(np.uint64)
            starts = candidate_stretches(words, begins, repeated, powers, size)
            where = np.searchsorted(begins, starts, "right") - 1
            found = [pa.array((starts - begins[where]).astype(np.int32)), pa.array(contents(words, starts, starts + size, powers).view(np.int64))]
            rows = pa.array(where)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *found], names=[*key, "start", "w"])

    stretches = written(chosen.mapInArrow(cut, f"id {kind}, {_TEXT_HASH} long, start int, w long"), "stretches")
    first = stretches.groupBy("w").agg(F.min("id").alias("kept"), F.max("id").alias("last"), F.count("*").alias("many"))
    first = written(first.where("kept < last").select("w", "kept", "many"), "repeated-stretches")
    again = hot_join(stretches, first, "w").where("id > kept")
    return again.select(*key, "start", F.lit(size).alias("n"), "kept", F.lit(True).alias("sure"))


def _merge(batches: Iterable[pa.RecordBatch], passage_words: int) -> Iterator[pa.RecordBatch]:
    """Passages (id, text_hash, start, n, kept) from rows (id, text_hash, start, n, kept, sure) sorted by id, hash and start.

    Sure rows are passages as they are; others make one with rows of the same keeper that they touch, if that is long
    enough. Passages that overlap or touch where both are sure are one.
    """
    kind, out = None, []
    now = None
    sure: list[list] = []
    others: dict[object, list[list]] = {}

    def add(runs: list[list], start: int, stop: int, kept: object) -> None:
        if runs and start <= runs[-1][1]:
            last = runs[-1]
            last[1], last[2] = max(last[1], stop), min(last[2], kept)
        else:
            runs.append([start, stop, kept])

    def close() -> None:
        long = [run for runs in others.values() for run in runs if run[1] - run[0] >= passage_words]
        runs: list[list] = []
        for start, stop, kept in sorted(sure + long):
            if runs and start < runs[-1][1]:
                runs[-1][1], runs[-1][2] = max(runs[-1][1], stop), min(runs[-1][2], kept)
            else:
                runs.append([start, stop, kept])
        out.extend((*now, start, stop - start, kept) for start, stop, kept in runs)
        sure.clear()
        others.clear()

    def done() -> pa.RecordBatch:
        types = [kind, pa.int64(), pa.int32(), pa.int32(), kind]
        arrays = [pa.array(list(c), t) for c, t in zip(zip(*out), types)]
        out.clear()
        return pa.RecordBatch.from_arrays(arrays, names=["id", _TEXT_HASH, "start", "n", "kept"])

    for batch in batches:
        kind = batch.column(0).type
        for key, text, start, n, kept, is_sure in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if now != (key, text):
                if now:
                    close()
                now = (key, text)
            add(sure if is_sure else others.setdefault(kept, []), start, start + n, kept)
        if len(out) > 10_000:
            yield done()
    if now:
        close()
    if out:
        yield done()


def without_words(text: bytes, starts: list[int], sizes: list[int]) -> bytes:
    """``text`` without the words of the spans (first word, number of words) and the white space before each span."""
    raw = np.frombuffer(text, np.uint8)
    white = np.isin(raw, np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8))
    ends = np.flatnonzero(~white & np.append(white[1:], True)) + 1
    stays = np.ones(len(raw), bool)
    for start, n in zip(starts, sizes):
        stays[ends[start - 1] if start else 0 : ends[start + n - 1]] = False
    return raw[stays].tobytes()


def remove_passages(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """``docs`` with repeated passages cut out of the texts; documents of which no word is left go.

    Documents without a repeated passage stay as they are, whatever they hold: null and empty texts, and rows with a null id.
    Rows that repeat an id with other texts each lose their own passages; rows alike in id and text lose the same. All
    columns stay, and ``n_chars`` is brought up to date; an empty table stays empty.
    """
    spans = repeated_passages(docs, id_column, text_column, passage_words)
    lists = F.sort_array(F.collect_list(F.struct("start", "n")))
    spans = spans.groupBy(F.col("id").alias("__id"), F.col(_TEXT_HASH).alias("__text")).agg(lists.alias("__spans"))

    def cut(texts: pa.Array, starts: pa.Array, sizes: pa.Array) -> pa.Array:
        rows = zip(*(x.to_pylist() for x in (texts, starts, sizes)))
        return pa.array([t if s is None else without_words(t, s, n) for t, s, n in rows], pa.binary())

    # The filter below would go under the projection with a call of its own, for which each task has another Python worker.
    cut = F.arrow_udf(cut, "binary").asNondeterministic()
    same = (docs[id_column] == spans["__id"]) & (F.xxhash64(docs[text_column]) == spans["__text"])
    joined = docs.join(spans, same, "left").drop("__id", "__text")
    touched = F.col("__spans").isNotNull()
    after = F.when(touched, cut(F.when(touched, utf8(text_column)), F.col("__spans.start"), F.col("__spans.n")).cast("string")).otherwise(F.col(text_column))
    out = joined.withColumn("__after", after).where(~touched | F.col("__after").rlike(r"\S"))
    if "n_chars" in docs.columns:
        count = F.when(touched, F.length("__after")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", count.cast(docs.schema["n_chars"].dataType))
    return out.withColumn(text_column, F.col("__after")).select(*docs.columns)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repeated passages of all documents, with the document that keeps each."""
    found = repeated_passages(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("start").alias("start_word"), F.col("n").alias("n_words"), F.col("kept").alias("kept_doc_id"))
