"""GIF as a media column: LZW, palettes, disposal, transparency, timed frames and colour histograms."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, utf8

#: Payloads are stored in frames of WIDTH x up to ROWS samples; a unit is what payloads are padded to.
WIDTH, ROWS, UNIT = 96, 96, 576
DELAY_CS = 10
PAD = b"\xff"
_LAST = 4095
#: Codes between two clear codes: the decoder's table is then as good as full.
_RUN = _LAST - 258


#: Pixels of the largest canvas that is decoded (its RGBA copy takes four bytes for each), and bytes of frames that a
#: worker holds before it hands them on.
MAX_CANVAS, HELD_BYTES = 1 << 24, 32 << 20


class GifError(ValueError):
    """What is read is no well-formed GIF."""


def _widths(count: int, size: int) -> np.ndarray:
    """Bits of each of ``count`` codes after a clear code, for a minimum code size."""
    entries = (1 << size) + 2 + np.maximum(np.arange(count) - 1, 0)
    return np.clip(np.floor(np.log2(entries)).astype(np.int64) + 1, size + 1, 12)


_WIDTHS = {size: _widths(1 << 13, size) for size in range(2, 9)}
_ENDS = {size: np.concatenate(([0], np.cumsum(w))) for size, w in _WIDTHS.items()}
#: Codes that follow so many others without a clear code have twelve bits each.
_FULL = np.full(1 << 13, 12)
_FULL_ENDS = np.concatenate(([0], np.cumsum(_FULL)))


def lzw_encode(pixels: bytes, size: int = 8) -> bytes:
    """The variable-width code stream of ``pixels``, with clear and end codes."""
    clear = 1 << size
    runs: list[list[int]] = []
    out: list[int] = []
    seen: dict[int, int] = {}
    code, following = (pixels[0], clear + 2) if pixels else (None, 0)
    get, put = seen.get, out.append
    for pixel in pixels[1:]:
        pair = code << 8 | pixel
        known = get(pair)
        if known is not None:
            code = known
            continue
        put(code)
        code = pixel
        seen[pair] = following
        following += 1
        if following > _LAST:
            runs.append(out)
            out, seen, following = [], {}, clear + 2
            get, put = seen.get, out.append
    if code is not None:
        out.append(code)
    runs.append(out)
    codes, widths = [np.array([clear])], [np.array([size + 1])]
    for i, run in enumerate(runs):
        codes.append(np.array([*run, clear + 1 if i == len(runs) - 1 else clear]))
        widths.append(_WIDTHS[size][: len(run) + 1])
    code_bits = np.concatenate(codes).astype("<u2")
    bits = np.unpackbits(code_bits.view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")[:, :12]
    return np.packbits(bits[np.arange(12) < np.concatenate(widths)[:, None]], bitorder="little").tobytes()


def lzw_decode(data: bytes, size: int, pixels: int) -> bytes:
    """The first ``pixels`` samples of a code stream; raises :class:`GifError` where it is malformed or too short.

    How many bits a code has depends only on how many codes came since the last clear code, so many codes are cut out
    together; strings are then rebuilt code by code. A full table stays as it is until a clear code comes, however late.
    """
    if not 2 <= size <= 8:
        raise GifError(f"minimum code size {size}")
    clear, stop = 1 << size, (1 << size) + 1
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    total, bit = 8 * len(data), 0
    roots = [bytes([x]) for x in range(clear)] + [b"", b""]
    out: list[bytes] = []
    length, fresh = 0, True
    strings, before = roots.copy(), b""
    while length < pixels:
        widths, steps = (_WIDTHS[size], _ENDS[size]) if fresh else (_FULL, _FULL_ENDS)
        ends = bit + steps
        many = int(np.searchsorted(ends, total, "right")) - 1
        if many <= 0:
            raise GifError("the code stream ends early")
        at = ends[:many]
        word = raw[at >> 3] | raw[(at >> 3) + 1] << 8 | raw[(at >> 3) + 2] << 16
        codes = (word >> (at & 7).astype(np.uint32)) & ((1 << widths[:many]) - 1).astype(np.uint32)
        marks = np.flatnonzero((codes == clear) | (codes == stop))
        upto = int(marks[0]) if len(marks) else many
        add, known = strings.append, len(strings)
        first = len(out)
        for code in codes[:upto].tolist():
            if code < known:
                string = strings[code]
            elif code == known and before:
                string = before + before[:1]
            else:
                raise GifError(f"code {code} is not in the table")
            out.append(string)
            if before and known <= _LAST:
                add(before + string[:1])
                known += 1
            before = string
        length += sum(map(len, out[first:]))
        if len(marks) and int(codes[upto]) == clear:
            bit, fresh = int(ends[upto + 1]), True
            strings, before = roots.copy(), b""
        elif not len(marks) and many == len(widths):
            bit, fresh = int(ends[many]), False
        elif length < pixels:
            raise GifError("the code stream ends early")
    return b"".join(out)[:pixels]


@dataclass
class Frame:
    """One frame as shown: its number, time, own rectangle and disposal, and the whole canvas as RGBA."""

    number: int
    start_ms: int
    delay_ms: int
    rect: tuple[int, int, int, int]
    disposal: int
    canvas: np.ndarray

    def histogram(self, bins: int = 8) -> list[int]:
        """Visible pixels by red, green and blue, ``bins`` equal ranges each."""
        seen = self.canvas[self.canvas[..., 3] > 0][:, :3].astype(np.int64) * bins // 256
        return np.concatenate([np.bincount(seen[:, c], minlength=bins) for c in range(3)]).tolist()


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while True:
        if at >= len(data):
            raise GifError("a block is cut off")
        count = data[at]
        if not count:
            return b"".join(parts), at + 1
        parts.append(data[at + 1 : at + 1 + count])
        at += 1 + count


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray | None, int]:
    if not flags & 0x80:
        return None, at
    count = 2 << (flags & 7)
    if at + 3 * count > len(data):
        raise GifError("a palette is cut off")
    return np.frombuffer(data, np.uint8, 3 * count, at).reshape(count, 3), at + 3 * count


def _rows(height: int, interlaced: bool) -> np.ndarray:
    """The canvas row of each stored row."""
    if not interlaced:
        return np.arange(height)
    return np.concatenate([np.arange(start, height, step) for start, step in ((0, 8), (4, 8), (2, 4), (1, 2))])


def decode(data: bytes, max_canvas: int = MAX_CANVAS) -> Iterator[Frame]:
    """The frames of a GIF as they appear: palettes, transparency, interlacing and disposal applied.

    Raises :class:`GifError` at the first fault, also for a canvas of more than ``max_canvas`` pixels.
    """
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise GifError("no GIF header")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    if width * height > max_canvas:
        raise GifError(f"a canvas of {width} x {height}")
    shared, at = _palette(data, 13, flags)
    canvas = np.zeros((height, width, 4), np.uint8)
    number = clock = 0
    disposal, delay, through = 0, 0, -1
    while True:
        if at >= len(data):
            raise GifError("no trailer")
        kind = data[at]
        if kind == 0x3B:
            return
        if kind == 0x21:
            body, end = _blocks(data, at + 2)
            if data[at + 1] == 0xF9 and len(body) >= 4:
                packed, hundredths, index = struct.unpack_from("<BHB", body)
                disposal, delay, through = packed >> 2 & 7, 10 * hundredths, index if packed & 1 else -1
            at = end
            continue
        if kind != 0x2C or at + 11 > len(data):
            raise GifError(f"unknown block {kind}")
        x, y, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
        own, at = _palette(data, at + 10, flags)
        colours = shared if own is None else own
        if colours is None:
            raise GifError("a frame has no palette")
        if x + w > width or y + h > height:
            raise GifError("a frame leaves the canvas")
        if at >= len(data):
            raise GifError("a frame is cut off")
        size = data[at]
        stream, at = _blocks(data, at + 1)
        index = np.frombuffer(lzw_decode(stream, size, w * h), np.uint8).reshape(h, w)
        if flags & 0x40:
            straight = np.empty_like(index)
            straight[_rows(h, True)] = index
            index = straight
        if index.size and int(index.max()) >= len(colours):
            raise GifError("a sample is not in the palette")
        kept = canvas.copy() if disposal == 3 else None
        part = canvas[y : y + h, x : x + w]
        if through < 0:
            part[..., :3], part[..., 3] = colours[index], 255
        else:
            shown = index != through
            part[shown] = np.concatenate([colours[index[shown]], np.full((int(shown.sum()), 1), 255, np.uint8)], axis=1)
        yield Frame(number, clock, delay, (x, y, w, h), disposal, canvas.copy())
        if disposal == 2:
            part[:] = 0
        elif kept is not None:
            canvas = kept
        number, clock = number + 1, clock + delay
        disposal, delay, through = 0, 0, -1


def encode(samples: bytes, width: int = WIDTH, rows: int = ROWS) -> bytes:
    """A grey-level GIF89a whose frames hold ``samples`` in order; their number must be a multiple of ``width``."""
    if not samples or len(samples) % width:
        raise GifError("samples must fill whole rows")
    height = min(rows, len(samples) // width)
    ramp = bytes(x for level in range(256) for x in (level, level, level))
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), ramp, b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0"]
    for at in range(0, len(samples), width * rows):
        part = samples[at : at + width * rows]
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1 << 2, DELAY_CS, 0, 0))
        out.append(struct.pack("<BHHHHBB", 0x2C, 0, 0, width, len(part) // width, 0, 8))
        stream = lzw_encode(part)
        out += [bytes([len(stream[i : i + 255])]) + stream[i : i + 255] for i in range(0, len(stream), 255)]
        out.append(b"\0")
    return b"".join([*out, b"\x3b"])


def padded(text: bytes, unit: int = UNIT) -> bytes:
    """``text`` with bytes 255 behind it up to a positive multiple of ``unit``."""
    return text + PAD * (-len(text) % unit if text else unit)


def store_as_gif(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (id, n_bytes, media): each whole text, padded, as the samples of a GIF.

    Null texts count as empty, an empty text is one unit of padding, long texts have many frames. Repeated rows and equal
    ids keep a row each; other columns are ignored; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            media = pa.array([encode(padded(x)) for x in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in texts], pa.int64()), media], names=["id", "n_bytes", "media"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("id"), utf8(text_column).alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, media binary")


_FRAME = "id {}, frame int, start_ms long, delay_ms long, x int, y int, w int, h int, disposal int, pixels binary, histogram array<long>, error string"


def frames(media: DataFrame, id_column: str = "id", media_column: str = "media", max_canvas: int = MAX_CANVAS) -> DataFrame:
    """A row for each frame of each GIF: times, rectangle, disposal, canvas as RGBA bytes and colour histogram.

    Bytes that are no well-formed GIF, or ask for more than ``max_canvas`` pixels, give the frames before the fault and a
    row whose ``error`` says what it is; a null or empty value gives such a row alone, a GIF without frames none.
    Repeated rows keep their frames each; other columns are ignored; an empty table gives an empty result.
    """
    small_batches(media.sparkSession)
    kind = media.schema[id_column].dataType.simpleString()
    schema = _FRAME.format(kind)
    names = [x.strip().split()[0] for x in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32(), pa.int64(), pa.int64(), *[pa.int32()] * 5, pa.binary(), pa.list_(pa.int64()), pa.string()]
        for batch in batches:
            for key, data in zip(batch.column(0), batch.column(1).to_pylist()):
                rows, held = [], 0

                def done() -> pa.RecordBatch:
                    arrays = [pa.array(list(c), t) for c, t in zip(zip(*rows), types)]
                    return pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(rows), batch.column(0).type), *arrays], names=names)

                try:
                    for f in decode(data or b"", max_canvas):
                        rows.append((f.number, f.start_ms, f.delay_ms, *f.rect, f.disposal, f.canvas.tobytes(), f.histogram(), None))
                        held += f.canvas.nbytes
                        if held >= HELD_BYTES:
                            yield done()
                            rows, held = [], 0
                except GifError as e:
                    rows.append((None,) * 10 + (str(e),))
                if rows:
                    yield done()

    return media.select(F.col(id_column).alias("id"), F.col(media_column).alias("media")).mapInArrow(run, schema)


def read_back(data: bytes) -> tuple[bytes, list[int], int]:
    """The samples of a grey-level GIF in order, their histogram in 8 ranges, and the number of frames."""
    parts, histogram, count = [], np.zeros(256, np.int64), 0
    for frame in decode(data):
        x, y, w, h = frame.rect
        levels = frame.canvas[y : y + h, x : x + w, 0]
        histogram += np.bincount(levels.ravel(), minlength=256)
        parts.append(levels.tobytes())
        count += 1
    return b"".join(parts), histogram.reshape(8, 32).sum(axis=1).tolist(), count


_DIGEST = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long"


def op2_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as a GIF, read back from the stored bytes, with digests and a colour histogram."""
    media = store_as_gif(table(spark, sf_dir, "documents"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            rows = []
            for data in batch.column(2).to_pylist():
                samples, histogram, count = read_back(data)
                feature = "grey8:" + ",".join(map(str, histogram))
                rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature, count))
            arrays = [pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [()] * len(types), types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["id", *(x.split()[0] for x in _DIGEST.split(", "))])

    kind = media.schema["id"].dataType.simpleString()
    return media.mapInArrow(run, f"id {kind}, {_DIGEST}").withColumnRenamed("id", "doc_id")
