"""Packing: every id once, in order, without padding."""

import itertools
import os
import zlib
from collections import defaultdict

import numpy as np

from sablefin.llm import packing
from sablefin.llm.tokens import encoder, rank_file

os.environ["TOKENIZERS_PARALLELISM"] = "false"


def test_hilbert_steps_are_of_length_one():
    for dimensions, bits in ((2, 4), (3, 3), (4, 2)):
        points = np.array(list(itertools.product(range(1 << bits), repeat=dimensions)))
        keys = packing.hilbert(points, bits)
        assert sorted(keys.tolist()) == list(range(len(points)))
        assert (np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def check(rows, ids, length):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(ids)
    for key, parts in pieces.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids[key])
            assert r.ids_crc32 == zlib.crc32(np.array(ids[key][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids[key])
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length and at & (at - 1) == 0


def test_query_equals_the_tokenizers_file(spark, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    encoded = theirs.encode_batch([r.text or "" for r in docs], add_special_tokens=False)
    check(packing.op8_hilbert_packing(spark, sf_dir).collect(), {r.doc_id: [*e.ids, 1] for r, e in zip(docs, encoded)}, 2048)


def test_edges(spark):
    texts = {1: None, 2: "", 3: "a b c " * 5000, 4: "same", 5: "same", 6: "a <|endoftext|> b", 7: "<|endoftext|>", None: "null id"}
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in texts.items()], "doc_id long, text string, key string, start int")
    encode = lambda t: encoder(*rank_file()).encode(t, allowed_special="all")
    rows = packing.pack(df, length=64, with_ids=True).withColumnRenamed("id", "doc_id").collect()
    check(rows, {k: [*encode(t or ""), 1] for k, t in texts.items()}, 64)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    assert packing.pack(df.limit(0)).count() == 0


def test_repeated_rows_are_documents_of_their_own(spark):
    rows = packing.pack(spark.createDataFrame([(1, "x y")] * 3, "doc_id long, text string"), length=8).collect()
    tokens = len(encoder(*rank_file()).encode_ordinary("x y")) + 1
    assert sum(r.length for r in rows) == 3 * tokens


def test_a_third_of_all_rows_with_one_text_is_split(spark):
    rows = [(i, "the same text again and again") for i in range(4000)] + [(4000 + i, f"text {i} " * (i % 50)) for i in range(8000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bounds = packing.bounds_of(df)
    sizes = [r["count"] for r in packing.with_place(df, bounds).groupBy("part").count().collect()]
    assert len(bounds) == 3 and len(sizes) == 4 and max(sizes) < 8000
    same = packing.with_place(df.where("doc_id < 4000"), bounds)
    assert same.select("place").distinct().count() > 3900


def test_like_texts_lie_together():
    directions = packing._directions()
    a, b, c = (np.frombuffer(t.encode(), np.uint8) for t in ("the cat sat on the mat " * 9, "the cat sat on the hat " * 9, "zwölf boxkämpfer jagen " * 9))
    points = [packing.project(x, directions) for x in (a, b, c)]
    assert np.abs(points[0] - points[1]).sum() < np.abs(points[0] - points[2]).sum()
    assert (packing.project(a[:2], directions) == 0.5).all()
