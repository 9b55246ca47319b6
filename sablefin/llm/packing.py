"""Packing of documents into token sequences along a Hilbert curve through hashed document vectors."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffers, small_batches, table, utf8
from .tokens import encoder, rank_file

SEQUENCE = 2048
#: The id that follows each document's own.
END_ID = 1
DIMENSIONS, BITS = 4, 10
_FEATURES = 1 << 12
#: Bytes of text that a partition should have; there are at least as many partitions as the session's shuffles have.
PARTITION_BYTES = 512 << 20
#: Documents by which a partition's bounds are found (drawn by hash), and how many are drawn at most.
SAMPLE, MOST_SAMPLED = 50, 1 << 20
#: Bits of a place on the curve that tell documents with one Hilbert key apart.
_TIE_BITS = 23
#: A sequence id is the partition's number times this, plus the sequence's number there.
_PER_PARTITION = 1 << 40


def _directions() -> np.ndarray:
    """A fixed direction of -1 and 1 for each hashed feature."""
    return np.where(np.random.RandomState(20240229).rand(_FEATURES, DIMENSIONS) < 0.5, -1.0, 1.0)


def project(text: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """A whole text, as bytes, in ``DIMENSIONS`` coordinates from 0 to 1: its hashed byte trigrams' counts, of length 1,
    projected on fixed random directions. Without trigrams all are 0.5."""
    if len(text) < 3:
        return np.full(directions.shape[1], 0.5)
    wide = text.astype(np.uint32)
    grams = (wide[:-2] | wide[1:-1] << 8 | wide[2:] << 16) * np.uint32(2654435761) >> np.uint32(20)
    counts = np.bincount(grams, minlength=_FEATURES)
    return np.clip(counts @ directions / np.sqrt(float(counts @ counts)) / 8 + 0.5, 0, 1)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Where points (rows of whole numbers below 2 ** bits) lie along the Hilbert curve.

    Skilling's transposed form: undo the excess work of rotations from the highest bit down, Gray-decode, and interleave
    the coordinates' bits.
    """
    x = points.astype(np.int64).copy()
    dimensions = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dimensions):
            inverted = (x[:, i] & q) != 0
            swap = np.where(inverted, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= np.where(inverted, p, swap)
            if i:
                x[:, i] ^= swap
        q >>= 1
    for i in range(1, dimensions):
        x[:, i] ^= x[:, i - 1]
    twist = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        twist ^= np.where(x[:, -1] & q, q - 1, 0)
        q >>= 1
    x ^= twist[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dimensions):
            key = key << 1 | (x[:, i] >> b & 1)
    return key


def with_place(docs: DataFrame, bounds: np.ndarray | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (id, place, part, text): each text as UTF-8 and its place on the curve, the Hilbert key followed by bits of a
    hash of id and text, so that documents with one key are spread over many places.

    ``part`` is the number of ``bounds`` (sorted places) up to the place. Null texts count as empty; repeated rows keep a
    row each and stand at one place; other columns are ignored; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    bounds = np.empty(0, np.int64) if bounds is None else bounds
    shared = docs.sparkSession.sparkContext.broadcast(bounds)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions = _directions()
        for batch in batches:
            raw, offsets = buffers(batch.column(2))
            points = np.array([project(raw[a:b], directions) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())])
            cells = np.minimum((points.reshape(-1, DIMENSIONS) * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
            place = hilbert(cells) << _TIE_BITS | batch.column(1).to_numpy()
            part = np.searchsorted(shared.value, place, "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(place), pa.array(part), batch.column(2)], names=["id", "place", "part", "text"])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), utf8(text_column).alias("text"))
    tie = F.xxhash64("id", "text").bitwiseAND(F.lit((1 << _TIE_BITS) - 1)).alias("tie")
    return rows.select("id", tie, "text").mapInArrow(run, f"id {kind}, place long, part int, text binary")


def bounds_of(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> np.ndarray:
    """The places at which partitions of about equal numbers of bytes begin, from a sample of the documents.

    The sample only decides how evenly documents are dealt: wherever bounds lie, each document is in one partition.
    """
    spark = docs.sparkSession
    size = F.octet_length(utf8(text_column))
    count, total = docs.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // PARTITION_BYTES))
    share = min(1.0, min(SAMPLE * parts, MOST_SAMPLED) / max(count, 1))
    draw = F.pmod(F.xxhash64(F.lit("packing"), id_column, text_column), F.lit(1 << 30)) < int(share * (1 << 30))
    drawn = with_place(docs.where(draw), None, id_column, text_column).select("place", F.octet_length("text").alias("bytes")).toArrow()
    places, sizes = (drawn.column(i).to_numpy().astype(np.int64) for i in range(2))
    order = np.argsort(places, kind="stable")
    filled = np.cumsum(sizes[order] + 1)
    wanted = filled[-1] * np.arange(1, parts) / parts if len(filled) else []
    return np.unique(places[order][np.searchsorted(filled, wanted)])


class _Packer:
    """Fills sequences one after another; the pieces of the one that is open wait, so that the last can be cut anew."""

    def __init__(self, base: int, length: int):
        self.next_id, self.length = base, length
        self.open: list[tuple] = []
        self.filled = 0
        self.done: list[tuple] = []

    def add(self, key, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            part = ids[at : at + self.length - self.filled]
            self.open.append((key, at, part, len(ids)))
            self.filled += len(part)
            at += len(part)
            if self.filled == self.length:
                self._close()

    def _close(self) -> None:
        offset = 0
        for key, start, part, total in self.open:
            self.done.append((key, start, len(part), zlib.crc32(part.astype("<u4").tobytes()), total, self.next_id, offset))
            offset += len(part)
        self.open, self.filled, self.next_id = [], 0, self.next_id + 1

    def finish(self) -> None:
        """Deal what is open to sequences whose lengths are powers of two, so that none needs padding."""
        rest, left = self.open, self.filled
        self.open, self.filled = [], 0
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            while room:
                key, start, part, total = rest.pop(0)
                self.open.append((key, start, part[:room], total))
                if len(part) > room:
                    rest.insert(0, (key, start + room, part[room:], total))
                room -= min(room, len(part))
            self._close()


_PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    length: int = SEQUENCE,
    ranks: tuple[str, ...] | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """Rows (id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]): the pieces of packed sequences.

    Documents are range-sorted by their place on the curve and each partition's documents are put on end, each followed by
    ``END_ID``, and cut into sequences of ``length``; what is left at a partition's end is dealt to sequences whose lengths
    are powers of two. So no sequence has padding, and documents with one Hilbert key need not share a partition. Bounds
    are fixed beforehand, so a lost executor's documents are packed alike again. Null and empty texts are
    documents of one id. Rows that repeat an id are documents of their own; null ids come first; other columns are
    ignored; an empty table gives an empty result. ``with_ids`` adds each piece's token ids.
    """
    ranks = ranks or rank_file()
    schema_ids = ", ids array<int>" if with_ids else ""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*ranks).encode_to_numpy
        packer = _Packer(TaskContext.get().partitionId() * _PER_PARTITION, length)
        kept_ids: list[np.ndarray] = []
        id_type = None
        if with_ids:
            close = packer._close

            def keep_and_close() -> None:
                kept_ids.extend(part for _, _, part, _ in packer.open)
                close()

            packer._close = keep_and_close

        def out() -> pa.RecordBatch:
            columns = list(zip(*packer.done))
            arrays = [pa.array(list(columns[0]), id_type), *(pa.array(list(c), pa.int64()) for c in columns[1:])]
            names = ["id", *(x.split()[0] for x in _PIECE.split(", "))]
            if with_ids:
                arrays.append(pa.array([x.astype(np.int32) for x in kept_ids], pa.list_(pa.int32())))
                names.append("ids")
                kept_ids.clear()
            packer.done = []
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            id_type = batch.column(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                packer.add(key, np.append(encode(text.decode("utf-8", "replace"), allowed_special="all"), np.uint32(END_ID)))
            if packer.done:
                yield out()
        packer.finish()
        if packer.done:
            yield out()

    kind = docs.schema[id_column].dataType.simpleString()
    bounds = bounds_of(docs, id_column, text_column)
    dealt = with_place(docs, bounds, id_column, text_column).repartitionById(len(bounds) + 1, "part")
    return dealt.sortWithinPartitions("place", "id", "text").select("id", "text").mapInArrow(run, f"id {kind}, {_PIECE}{schema_ids}")


def op8_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return pack(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
