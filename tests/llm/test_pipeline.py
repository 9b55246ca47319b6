"""The pipeline's stages, each held against what it must do to its input."""

import os
import random
import re

import corpus_pipeline
from sablefin.llm import pipeline, simhash, toxicity
from sablefin.llm.common import is_held_out, shared_dir, written
from sablefin.llm.tokens import counter, rank_file
from tests.llm.test_decontaminate import brute as leaks

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_in_order(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "substring_dedup", "decontamination", "packing"]

    clean = written(stages["toxicity"](spark, docs, sf_dir), "t")
    assert clean.columns == COLUMNS
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~is_held_out(5, 0)))
    rejected = {r.id for r in toxicity.classify(docs, model).where("predicted = 1").collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - rejected

    single = written(stages["near_duplicates"](spark, clean, sf_dir), "t")
    assert single.columns == COLUMNS
    assert {r.doc_id for r in single.collect()} == {r.component_id for r in simhash.near_duplicates(clean).collect()}

    cut = written(stages["substring_dedup"](spark, single, sf_dir), "t")
    assert cut.columns == COLUMNS
    before = {r.doc_id: r for r in single.collect()}
    for r in cut.collect():
        words = iter((before[r.doc_id].text or "").split())
        assert all(w in words for w in (r.text or "").split())  # a subsequence
        assert r.n_chars == len(r.text or "") or r == before[r.doc_id]

    kept = written(stages["decontamination"](spark, cut, sf_dir), "t")
    assert kept.columns == COLUMNS
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [(r.doc_id, r.text) for r in cut.collect()]
    assert {r.doc_id for r in kept.collect()} == {k for k, _ in rows} - {k for k, _ in leaks(rows, items)}

    count = counter(rank_file())
    pieces = stages["packing"](spark, kept, sf_dir).collect()
    assert sum(p.length for p in pieces) == sum(count(r.text or "") + 1 for r in kept.collect())
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).drop("sequence_id", "offset", "start", "length", "ids_crc32").distinct().collect())) == sorted(
        {(p.doc_id, p.doc_tokens) for p in pieces}
    )


def edge_rows():
    """Repeated ids with other texts, null ids and texts, empty texts, copies, a leak, a repeated passage, toxic texts."""
    rng = random.Random(2)
    some = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    bad = lambda n: " ".join(rng.choice(["zounds", "foozles", f"w{rng.randrange(99)}"]) for _ in range(n))
    passage, leak, twin = some(80), some(30), some(90)
    rows = [(i, bad(30) if i % 2 else some(30)) for i in range(200)]
    rows += [(300, twin), (301, twin), (301, "own " + some(60)), (None, twin), (None, bad(40)), (302, None), (302, ""), (302, None), (303, " \n ")]
    rows += [(310, some(30) + "\n" + passage), (311, passage + "\n" + some(40)), (311, some(50)), (320, some(20) + " " + leak), (320, some(25)), (None, leak)]
    labels = [(i, i % 2) for i in range(200)]
    return rows, labels, leak, passage


def test_stages_on_edge_rows(spark, tmp_path):
    rows, labels, leak, passage = edge_rows()
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kind = "doc_id long, text string, lang string, source string, n_chars long, id long, start int, words string, fp long, component int, place long, text_hash long"
    docs = spark.createDataFrame([(k, t, "x", "y", len(t or ""), 1, 2, "w", 3, 4, 5, 6) for k, t in rows], kind)
    stages = dict(corpus_pipeline.STAGES)
    texts = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)

    toxic = lambda t: "zounds" in (t or "") or "foozles" in (t or "")
    clean = written(stages["toxicity"](spark, docs, str(tmp_path)), "t")
    assert clean.columns == docs.columns and texts(clean) == sorted(((k, t) for k, t in rows if not toxic(t)), key=str)

    single = written(stages["near_duplicates"](spark, clean, str(tmp_path)), "t")
    left = [(k, t) for k, t in texts(clean) if (k, t) not in {(301, rows[200][1]), (303, " \n ")}]
    assert single.columns == docs.columns and texts(single) == left

    cut = written(stages["substring_dedup"](spark, single, str(tmp_path)), "t")
    assert cut.columns == docs.columns
    expected = [(k, t.split("\n")[1] if k == 311 and "\n" in t else t) for k, t in ((k, t or "") for k, t in left)]
    assert sorted((k, (t or "").strip()) for k, t in texts(cut) if k is not None) == sorted((k, t.strip()) for k, t in expected if k is not None)
    assert sum(k is None for k, _ in texts(cut)) == 2

    kept = written(stages["decontamination"](spark, cut, str(tmp_path)), "t")
    assert kept.columns == docs.columns and texts(kept) == [(k, t) for k, t in texts(cut) if leak not in (t or "")]

    count = counter(rank_file())
    pieces = stages["packing"](spark, kept, str(tmp_path)).collect()
    assert sum(p.length for p in pieces) == sum(count(t or "") + 1 for _, t in texts(kept))
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), str(tmp_path))
        assert empty.count() == 0 and (name == "packing" or empty.columns == docs.columns)


def test_what_a_run_leaves_in_the_shared_folder(spark, sf_dir):
    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    corpus_pipeline.run(spark, sf_dir).count()
    assert len([x for x in set(os.listdir(folder)) - before if x.startswith("sablefin-")]) == 1  # the last stage's input


def test_each_stage_calls_an_operator():
    text = open(pipeline.__file__, encoding="utf-8").read()
    assert re.findall(r"^from \. import (.*)$", text, re.M) == ["decontaminate, packing, simhash, substrings, toxicity"]
    assert corpus_pipeline.STAGES is pipeline.STAGES and corpus_pipeline.run is pipeline.run
