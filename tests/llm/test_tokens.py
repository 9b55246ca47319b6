"""Token trees against encoding anew, and the rank file against the tokenizers file."""

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sablefin.llm.tokens import TokenTree, apply_edits, build_trees, counter, encoder, op3_token_counts, rank_file, revision

os.environ["TOKENIZERS_PARALLELISM"] = "false"


@pytest.fixture(scope="module")
def count():
    return counter(rank_file())


PIECES = st.sampled_from(["a", " ", "\n", "  ", "don't", " 12", "é", "!!", "\x1c", "\x85", "word ", "\t", "　", "中文", "<|endoftext|>", "<|endof", "text|>", "|>", "<", "x1's.", "'ll"])
EDITS = st.lists(st.tuples(st.integers(-3, 400), st.integers(-3, 200), st.lists(PIECES, max_size=5)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(st.lists(PIECES, max_size=120), EDITS, st.sampled_from([1, 4, 32]))
def test_edits_give_the_count_of_the_new_text(parts, edits, leaf):
    count = counter(rank_file())
    text = "".join(parts)
    tree = TokenTree(text, count, leaf)
    assert tree.total == count(text)
    for start, removed, inserted in edits:
        start, removed, new = min(max(start, 0), len(text)), max(removed, 0), "".join(inserted)
        text = text[:start] + new + text[start + removed :]
        assert tree.edit(start, removed, new) == count(text)
        assert tree.text == text and len(tree) == len(text)
    again = TokenTree.kept(text, *tree.state(), count)
    assert again.total == tree.total and again.encoded_chars == 0 and again.edit(3, 2, "new ") == count(text[:3] + "new " + text[5:])


def test_an_edit_encodes_little(count):
    tree = TokenTree("some words here " * 20_000, count)
    before = tree.encoded_chars
    tree.edit(150_000, 4, "other")
    assert tree.encoded_chars - before < 1000


def test_rank_file_gives_the_ids_of_the_tokenizers_file(spark, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    texts += ["", " ", "a  b\n\n c\t\td", "I'll don't 've", "12345 ²³ ٣٣", "😀👍🏽", "x" * 5000, "<|endoftext|>", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "<|<|endoftext|>|>", "<|endof text|> end  <|endoftext|>  x", "a\x00b\x1c\x85 ", "  \n"]
    mine = encoder(*rank_file())
    for text, encoded in zip(texts, theirs.encode_batch(texts, add_special_tokens=False)):
        assert mine.encode(text, allowed_special="all") == encoded.ids


def test_texts_without_blanks_have_short_leaves(count):
    tree = TokenTree("word,next;12.34-" * 20_000, count)
    before = tree.encoded_chars
    assert max(map(len, tree.leaves)) < 500 and tree.total == count(tree.text)
    tree.edit(150_000, 4, "other")
    assert tree.encoded_chars - before < 1000


def test_edge_rows(spark, count):
    from pyspark.sql import functions as F

    rows = [(1, None), (1, None), (2, ""), (None, "some words"), (3, "a b " * 3000)]
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, n_tokens int, edits string")
    trees = build_trees(df)
    expected = sorted((str(k), count(t or "")) for k, t in rows)
    assert sorted((str(r.id), r.n_tokens) for r in trees.collect()) == expected
    same = apply_edits(trees, F.lit(None))
    assert sorted((str(r.id), r.n_tokens) for r in same.collect()) == expected and {r.encoded_chars for r in same.collect()} == {0}
    nulls = F.array(F.struct(F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("removed"), F.lit(None).cast("string").alias("inserted")))
    assert sorted((str(r.id), r.n_tokens) for r in apply_edits(trees, nulls, keep_text=False).collect()) == expected
    assert build_trees(df.limit(0)).count() == 0


def test_trees_follow_edit_upon_edit(spark, count):
    from pyspark.sql import functions as F

    text = "one two  three\n" * 400
    change = lambda at, n, new: F.array(F.struct(F.lit(at).cast("long").alias("start"), F.lit(n).cast("long").alias("removed"), F.lit(new).alias("inserted")))
    trees = build_trees(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    for at, n, new in ((100, 7, "four"), (0, 0, "x"), (3000, 500, " "), (10**9, 5, " end")):
        trees = apply_edits(trees, change(at, n, new))
        at = min(at, len(text))
        text = text[:at] + new + text[at + n :]
        row = trees.first()
        assert bytes(row.text).decode() == text and row.n_tokens == count(text) and row.encoded_chars < 2000


def test_a_tree_of_another_text_is_refused(count):
    with pytest.raises(ValueError):
        TokenTree.kept("abc", [2], [1], count)


def test_query_equals_encoding_anew(spark, sf_dir, count):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op3_token_counts(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id]
        new = text[: len(text) // 3] + " A sentence was put in here." + text[len(text) // 3 :]
        new = new[: len(text) // 2] + new[len(text) // 2 + 40 :]
        new = "Revised:" + new[12:]
        assert (r.n_tokens, r.edited_tokens, r.n_chars, r.edited_chars) == (count(text), count(new), len(text), len(new))


def test_revision_is_an_array_of_edits(spark):
    from pyspark.sql import functions as F

    assert len(spark.createDataFrame([("abc",)], "text string").select(revision(F.col("text"))).first()[0]) == 3
