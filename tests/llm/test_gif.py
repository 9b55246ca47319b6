"""GIF: exact round trips, hand-made files, and the query's digests."""

import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sablefin.llm import gif


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.integers(2, 8), st.integers(1, 6))
def test_lzw_round_trip(data, size, repeats):
    pixels = bytes(x % (1 << size) for x in data) * repeats
    assert gif.lzw_decode(gif.lzw_encode(pixels, size), size, len(pixels)) == pixels


def test_lzw_with_full_tables():
    rng = np.random.RandomState(1)
    pixels = rng.randint(0, 256, 60_000).astype(np.uint8).tobytes()
    assert gif.lzw_decode(gif.lzw_encode(pixels), 8, len(pixels)) == pixels


def late_clear(codes, size=8):
    """A code stream of single samples with one clear code at the beginning."""
    entries, value, at = 258, 0, 0
    for i, code in enumerate([256, *codes, 257]):
        value |= code << at
        at += min(12, max(9, entries.bit_length()))
        if i >= 2 and entries < 4096:
            entries += 1
    return value.to_bytes(-(-at // 8), "little")


@pytest.mark.parametrize("count", [4800, 8189, 8190, 8191, 8192, 8193, 9000, 20_000])
def test_lzw_without_clear_codes_stays_at_twelve_bits(count):
    pixels = bytes(i * 7 % 251 for i in range(count))
    data = late_clear(list(pixels))
    assert gif.lzw_decode(data, 8, count) == pixels
    with pytest.raises(gif.GifError):
        gif.lzw_decode(data, 8, count + 1)


def frame(x, y, w, h, pixels, disposal=0, delay=0, through=None, palette=None, interlaced=False, size=2):
    flags = (0x80 | (size - 1) if palette else 0) | (0x40 if interlaced else 0)
    control = struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | (through is not None), delay, through or 0, 0)
    stream = gif.lzw_encode(bytes(pixels), size)
    blocks = b"".join(bytes([len(stream[i : i + 255])]) + stream[i : i + 255] for i in range(0, len(stream), 255))
    return control + struct.pack("<BHHHHB", 0x2C, x, y, w, h, flags) + bytes(sum(palette or [], [])) + bytes([size]) + blocks + b"\0"


SHARED = [[0, 0, 0], [255, 0, 0], [0, 255, 0], [0, 0, 255]]


def file(w, h, *frames, palette=SHARED):
    flags = 0x80 | 1 if palette else 0
    return b"GIF89a" + struct.pack("<HHBBB", w, h, flags, 0, 0) + bytes(sum(palette or [], [])) + b"".join(frames) + b"\x3b"


def colours(shot):
    return [tuple(p) for p in shot.canvas.reshape(-1, 4).tolist()]


RED, GREEN, BLUE, CLEAR = (255, 0, 0, 255), (0, 255, 0, 255), (0, 0, 255, 255), (0, 0, 0, 0)


def test_palettes_transparency_and_disposal():
    own = [[9, 9, 9], [8, 8, 8], [7, 7, 7], [6, 6, 6]]
    data = file(
        2, 1,
        frame(0, 0, 2, 1, [1, 1], disposal=1, delay=7),
        frame(0, 0, 2, 1, [2, 3], disposal=3, through=3, delay=2),
        frame(1, 0, 1, 1, [2], disposal=2),
        frame(0, 0, 1, 1, [0], palette=own),
    )
    shots = list(gif.decode(data))
    assert [colours(s) for s in shots] == [[RED, RED], [GREEN, RED], [RED, GREEN], [(9, 9, 9, 255), CLEAR]]
    assert [(s.start_ms, s.delay_ms) for s in shots] == [(0, 70), (70, 20), (90, 0), (90, 0)]
    assert shots[1].histogram(2) == [1, 1, 1, 1, 2, 0]


def test_interlaced_rows():
    stored = [0, 8, 4, 2, 6, 1, 3, 5, 7]
    shot = next(gif.decode(file(1, 9, frame(0, 0, 1, 9, [r % 4 for r in stored], interlaced=True))))
    assert [c[:3] for c in colours(shot)] == [tuple(SHARED[r % 4]) for r in range(9)]


@pytest.mark.parametrize("data", [b"", b"GIF89a", b"PNG", file(1, 1)[:-1], file(1, 1, frame(0, 0, 1, 1, [0]))[:-6], file(1, 1, frame(0, 0, 2, 1, [0, 0])), file(1, 1, frame(0, 0, 1, 1, [0]), palette=None)])
def test_faults_are_told(data):
    with pytest.raises(gif.GifError):
        list(gif.decode(data))


def sample():
    own = [[9, 9, 9], [8, 8, 8], [7, 7, 7], [6, 6, 6]]
    return file(
        3, 9,
        frame(0, 0, 3, 9, [i % 4 for i in range(27)], disposal=1, delay=7, interlaced=True),
        frame(0, 0, 2, 1, [2, 3], disposal=3, through=3, delay=2, palette=own),
        frame(1, 0, 1, 1, [2], disposal=2),
    )


def outcome(data):
    try:
        return len(list(gif.decode(data, 1 << 16)))
    except gif.GifError:
        return None


def test_every_prefix_and_every_changed_byte_is_frames_or_a_fault():
    data = sample()
    assert outcome(data) == 3
    assert all(outcome(data[:n]) is None for n in range(len(data)))
    for at in range(len(data)):
        for byte in {0, 1, 0x21, 0x2C, 0x3B, 0x7F, 0x80, 0xFF, data[at] ^ 1, data[at] ^ 0x80}:
            outcome(data[:at] + bytes([byte]) + data[at + 1 :])


def test_a_large_canvas_is_a_fault(spark):
    huge = b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0, 0, 0) + b"\x3b"
    with pytest.raises(gif.GifError):
        list(gif.decode(huge))
    row = gif.frames(spark.createDataFrame([(1, huge)], "id long, media binary")).first()
    assert row.id == 1 and row.frame is None and "65535" in row.error


def test_frames_of_a_column(spark):
    good = file(2, 1, frame(0, 0, 2, 1, [1, 2], delay=3), frame(1, 0, 1, 1, [3]))
    rows = [(1, good), (2, b"junk"), (3, None), (4, good[:-1])]
    found = gif.frames(spark.createDataFrame(rows, "id long, media binary")).orderBy("id", "frame").collect()
    assert [(r.id, r.frame, r.error is None) for r in found if r.frame is not None] == [(1, 0, True), (1, 1, True), (4, 0, True), (4, 1, True)]
    assert sorted(r.id for r in found if r.error) == [2, 3, 4]
    assert bytes(found[-1].pixels) == bytes(RED + BLUE) if found[-1].frame == 1 else True


@pytest.mark.parametrize("size", [0, 1, 575, 576, 577, 96 * 96, 96 * 96 + 1, 30_000])
def test_payload_round_trip(size):
    payload = gif.padded(np.random.RandomState(size).bytes(size))
    assert len(payload) % 576 == 0 and payload
    samples, histogram, frames = gif.read_back(gif.encode(payload))
    assert samples == payload and sum(histogram) == len(payload) and frames == -(-len(payload) // (96 * 96))


def test_query_gives_the_digests(spark, sf_dir):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in gif.op2_gif_media(spark, sf_dir).collect():
        text = texts.pop(r.doc_id)
        payload = text + b"\xff" * (-len(text) % 576 if text else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(m := gif.encode(payload)), hashlib.sha256(m).hexdigest())
    assert not texts
