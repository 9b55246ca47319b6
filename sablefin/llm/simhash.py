"""SimHash near-duplicate groups, compared bit plane by bit plane."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_broadcast, cells, small_batches, table, temporary, utf8, written
from .components import connected_components

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 2
#: A bucket with more fingerprints than this is cut into cells, each of two such parts.
CELL = 8192
#: Up to so many fingerprints, all pairs of a bucket share bit planes with those of other buckets, so many pairs at once.
SMALL, PAIRS = 24, 1 << 17
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes) -> int:
    """The 64-bit SimHash of a text given as UTF-8, as an unsigned number.

    A-Z are lower-cased, words are runs without ASCII white space, features are shingles of three words (repeats
    included; a shorter text is one shingle) hashed by XXH64 with seed 42, and a bit is set if it is in over half the
    hashes. A text without words has fingerprint 0.
    """
    words = text.lower().split()
    count = len(words) - SHINGLE_WORDS + 1
    if not words:
        return 0
    joined = b" ".join(words)
    if count <= 1:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:count].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE_WORDS - 1 :].tolist())), "<u8", count)
    ones = np.zeros(64)
    for at in range(0, count, 4096):
        bits = np.unpackbits(hashes[at : at + 4096].view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += bits.astype(np.float32).sum(axis=0)
    return int(np.packbits(ones * 2 > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (id, fp): the SimHash of every whole text as a signed long.

    Null texts count as empty (fingerprint 0). Repeated rows and equal ids keep a row each; other columns are ignored; an
    empty table gives an empty result.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(x) for x in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("id"), utf8(text_column).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def bit_planes(values: np.ndarray) -> np.ndarray:
    """64 rows: row k holds bit k of every value, 64 values to a word; missing values at the end are zero."""
    bits = np.unpackbits(np.ascontiguousarray(values, "<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
    padded = np.zeros((64, -(-max(len(values), 1) // 64) * 64), np.uint8)
    padded[:, : len(values)] = bits.T
    return np.packbits(padded, axis=1, bitorder="little").view("<u8")


def within(planes: np.ndarray, lanes: np.ndarray, query: int, radius: int = RADIUS) -> np.ndarray:
    """The lanes (as words with a bit each) whose value differs from ``query`` in at most ``radius`` bits.

    One plane after another is XORed with the query's bit and added to vertical carry-save counters of just enough bits
    to hold the radius; a lane whose counter overflows leaves ``lanes``, and words without any lane left are given up.
    """
    alive = np.flatnonzero(lanes)
    left = lanes[alive]
    width = (radius + 1).bit_length()
    counters = np.zeros((width, len(alive)), np.uint64)
    for k in range(64):
        if not len(alive):
            break
        carry = planes[k][alive]
        if query >> k & 1:
            carry = ~carry
        carry &= left
        for row in counters:
            row_carry = row & carry
            row ^= carry
            carry = row_carry
        over = carry
        equal = np.full(len(alive), _ALL)
        for j, row in enumerate(counters):
            equal &= row if (radius + 1) >> j & 1 else ~row
        left &= ~(over | equal)
        if k % 8 == 7:
            keep = left != 0
            if not keep.all():
                alive, left, counters = alive[keep], left[keep], counters[:, keep]
    out = np.zeros_like(lanes)
    out[alive] = left
    return out


def small_links(buckets: list[np.ndarray], radius: int = RADIUS) -> list[np.ndarray]:
    """For each bucket of a few values the pairs (positions) of at most ``radius`` bits, all buckets compared at once.

    Each two values of a bucket are a lane, whose bits are those in which they differ, so the planes of all lanes count the
    distances of 64 pairs at a time, and words of lanes are given up once all pairs in them are too far apart.
    """
    corners = [np.column_stack(np.triu_indices(len(x), 1)) for x in buckets]
    apart = [x[c[:, 0]] ^ x[c[:, 1]] for x, c in zip(buckets, corners)]
    if not sum(map(len, apart)):
        return corners
    differ = np.concatenate(apart)
    lanes = np.packbits(np.arange(-(-len(differ) // 64) * 64) < len(differ), bitorder="little").view("<u8").copy()
    near = np.unpackbits(within(bit_planes(differ), lanes, 0, radius).view(np.uint8), bitorder="little")[: len(differ)].astype(bool)
    ends = np.cumsum([0, *map(len, corners)])
    return [c[near[a:b]] for c, a, b in zip(corners, ends[:-1].tolist(), ends[1:].tolist())]


def spanning_links(values: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links (positions in ``values``) that connect exactly what links of at most ``radius`` bits connect.

    Each value is searched for once among those not reached yet, so there are fewer links than values, however dense the
    cell is.
    """
    n = len(values)
    numbers = [int(x) for x in values]
    planes, lanes = bit_planes(values), np.zeros(-(-max(n, 1) // 64) * 64, np.uint8)
    lanes[:n] = 1
    lanes = np.packbits(lanes, bitorder="little").view("<u8").copy()
    links, at_word = [], 0
    while True:
        while at_word < len(lanes) and not lanes[at_word]:
            at_word += 1
        if at_word == len(lanes):
            return links
        low = int(lanes[at_word])
        queue = [at_word * 64 + (low & -low).bit_length() - 1]
        lanes[at_word] ^= np.uint64(low & -low)
        while queue:
            at = queue.pop()
            found = within(planes, lanes, numbers[at], radius)
            lanes &= ~found
            near = np.flatnonzero(np.unpackbits(found.view(np.uint8), bitorder="little")).tolist()
            links += [(at, x) for x in near]
            queue += near


def _block_keys(radius: int) -> list[F.Column]:
    """A key for each way in which two fingerprints within ``radius`` bits can agree on the rest of radius + 2 blocks."""
    blocks = radius + 2
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(blocks)]
    keys = []
    for kept in combinations(range(blocks), 2):
        mask = masks[kept[0]] | masks[kept[1]]
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(len(keys)).alias("way"), F.col("fp").bitwiseAND(F.lit(signed)).alias("key")))
    return keys


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Rows (u, v) of fingerprints that connect what ``radius`` bits link, from rows (fp) without repeats.

    Two fingerprints within the radius agree on two of radius + 2 blocks, so each is put into the bucket of every pair
    of blocks. A bucket above ``CELL`` is cut by hash into parts, and each two parts form a cell; no bucket is too large
    and no link is lost. Buckets of one fingerprint end there.
    """
    keyed = distinct.select("fp", F.explode(F.array(*_block_keys(radius))).alias("at")).select("fp", "at.way", "at.key")
    dealt = (
        cells(keyed, ["way", "key"], "fp", CELL)
        .select("way", "key", "a", "b", "fp")
        .repartition("way", "key", "a", "b")
        .sortWithinPartitions("way", "key", "a", "b", "fp")
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        held: list[np.ndarray] = []
        waiting: list[np.ndarray] = []
        pairs = 0

        def rows(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            linked = np.concatenate([np.empty((0, 2), np.uint64), *found]).view(np.int64)
            if len(linked):
                yield pa.RecordBatch.from_arrays([pa.array(linked[:, 0]), pa.array(linked[:, 1])], names=["u", "v"])

        def compared() -> Iterator[pa.RecordBatch]:
            nonlocal waiting, pairs
            yield from rows([x[near] for x, near in zip(waiting, small_links(waiting, radius))])
            waiting, pairs = [], 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal held, pairs
            values = np.concatenate(held).view(np.uint64) if held else np.empty(0, np.uint64)
            held = []
            if len(values) > SMALL:
                found = spanning_links(values, radius)
                yield from rows([values[np.array(found)]] if found else [])
            elif len(values) > 1:
                waiting.append(values)
                pairs += len(values) * (len(values) - 1) // 2
                if pairs >= PAIRS:
                    yield from compared()

        for batch in batches:
            if not batch.num_rows:
                continue
            *cell, fps = (batch.column(i).to_numpy() for i in range(5))
            change = np.flatnonzero(np.any([x[1:] != x[:-1] for x in cell], axis=0)) + 1
            starts = [0, *change.tolist(), batch.num_rows]
            for a, b in zip(starts, starts[1:]):
                if now != (this := tuple(int(x[a]) for x in cell)):
                    yield from close()
                    now = this
                held.append(fps[a:b])
        yield from close()
        yield from compared()

    return dealt.mapInArrow(run, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", radius: int = RADIUS) -> DataFrame:
    """Rows (id, fp, component_id): every document with its fingerprint and the smallest id it is linked to.

    Only distinct fingerprints are compared, so copies cost nothing more. Null and empty texts have fingerprint 0 and
    are linked like any other; a null id never names a component unless a component has no other id; repeated rows and
    equal ids with other texts each keep a row. Other columns are ignored. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    with temporary() as keep:
        prints = keep(written(fingerprints(docs, id_column, text_column), "fingerprints"))
        named = keep(_named(prints, radius))
    return prints.join(named, "fp").select("id", "fp", "component_id")


def _named(prints: DataFrame, radius: int) -> DataFrame:
    """Rows (fp, component_id): each fingerprint of ``prints`` with the smallest id it is linked to."""
    groups = prints.groupBy("fp").agg(F.min("id").alias("least"))
    joined = connected_components(written(links(groups.select("fp"), radius), "links"))
    classes = groups.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    return written(classes.join(least, "component").select("fp", "component_id"), "classes")


def keep_first(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` without all but one document of each near-duplicate group; all columns stay.

    The document with the smallest id stays (of repeated rows with that id, all stay); rows with a null id stay. Of rows that
    repeat an id with other texts, each goes or stays with its own group.
    """
    small_batches(docs.sparkSession)
    marked = docs.withColumn("__row", F.struct(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("text_hash")))
    with temporary() as keep:
        prints = written(fingerprints(marked, "__row", text_column).select("id.id", "id.text_hash", "fp"), "fingerprints")
        found = prints.join(_named(prints, RADIUS), "fp").where("id <> component_id")
        gone = keep(written(found.select(F.col("id").alias("__gone"), F.col("text_hash").alias("__text")).distinct(), "near-duplicates"))
    same = (docs[id_column] == gone["__gone"]) & (F.xxhash64(docs[text_column]) == gone["__text"])
    return docs.join(bounded_broadcast(gone), same, "left_anti")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its SimHash in hexadecimal and its component."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
