"""Tokens of whole texts, and counts that follow edits without encoding a text anew."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, utf8

#: Characters that a leaf of the tree should have; it ends at the next place where a token must end.
LEAF_CHARS = 128
#: Where a pre-token ends whatever else a text holds: before a space or line end, behind a run of letters or of digits, and
#: between other characters and a letter or digit (but for an apostrophe, which may begin a contraction). The last three
#: leave out characters that special tokens are made of, beside letters and digits, so no cut lies within one.
_CUT = regex.compile(
    r"(?<=\S)(?=[ \n])|(?<=\p{L})(?=[^\s\p{L}<|>])|(?<=\p{N})(?=[^\s\p{N}<|>])|(?<=[^\s\p{L}\p{N}'<|>])(?=[\p{L}\p{N}])"
)
_SPECIAL_MARKS = frozenset("<|>")


def rank_file() -> tuple[str, str, str]:
    """The places of the vocabulary as ranks, the pattern of its pre-tokens, and the place of its ``tokenizers`` file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("byte_bpe_50k.json")


def special_tokens(path: str) -> dict[str, int]:
    """The added tokens of a ``tokenizers`` file with their ids; a text's occurrences of them are cut out before all else.

    Raises ValueError for tokens that cuts of a text could break, or that take in white space around them.
    """
    with open(path, encoding="utf-8") as lines:
        added = json.load(lines)["added_tokens"]
    for token in added:
        odd = {c for c in token["content"] if not c.isalnum()} - _SPECIAL_MARKS
        if odd or token["lstrip"] or token["rstrip"] or token["single_word"]:
            raise ValueError(f"special token {token['content']!r}")
    return {token["content"]: token["id"] for token in added}


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str, specials: str | None = None):
    """The byte-level BPE of a rank file, which gives the ids of the same vocabulary's ``tokenizers`` file ``specials``.

    Encode with ``allowed_special="all"``, so that the strings of special tokens become their ids as they do there.
    """
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special_tokens(specials) if specials else {})


def counter(ranks: tuple[str, ...]):
    """The function that counts a text's tokens."""
    encode = encoder(*ranks).encode
    return lambda text: len(encode(text, allowed_special="all"))


class TokenTree:
    """Token counts of one text in a segment tree over stretches of pre-tokens.

    A leaf ends only where a pre-token ends whatever else the text holds, so the leaves' counts add up to the text's. Nodes
    hold sums of characters and tokens. Only a text whose pre-tokens are long has long leaves.
    """

    def __init__(self, text: str, count, leaf_chars: int = LEAF_CHARS):
        self._count, self._leaf_chars = count, leaf_chars
        #: Characters handed to the encoder so far.
        self.encoded_chars = 0
        self._build(text)

    def _pieces(self, text: str) -> list[str]:
        out, at = [], 0
        while len(text) - at > 2 * self._leaf_chars and (cut := _CUT.search(text, at + self._leaf_chars)):
            out.append(text[at : cut.start()])
            at = cut.start()
        return [*out, text[at:]]

    def _tokens(self, text: str) -> int:
        self.encoded_chars += len(text)
        return self._count(text) if text else 0

    @classmethod
    def kept(cls, text: str, leaf_chars: list[int], leaf_tokens: list[int], count, goal: int = LEAF_CHARS) -> TokenTree:
        """The tree of a text whose leaves were counted before; nothing is encoded. Raises ValueError if they don't fit."""
        tree = cls.__new__(cls)
        tree._count, tree._leaf_chars, tree.encoded_chars = count, goal, 0
        if sum(leaf_chars) != len(text) or len(leaf_chars) != len(leaf_tokens) or not leaf_chars:
            raise ValueError("the tree is not this text's")
        ends = list(accumulate(leaf_chars))
        tree._fill([text[end - size : end] for end, size in zip(ends, leaf_chars)], leaf_tokens)
        return tree

    def state(self) -> tuple[list[int], list[int]]:
        """Characters and tokens of the leaves, for :meth:`kept`; leaves that edits have emptied are left out."""
        rows = [(len(leaf), self._sums[self._size + i]) for i, leaf in enumerate(self.leaves) if leaf] or [(0, 0)]
        return [n for n, _ in rows], [t for _, t in rows]

    def _build(self, text: str) -> None:
        pieces = self._pieces(text)
        self._fill(pieces, [self._tokens(piece) for piece in pieces])

    def _fill(self, leaves: list[str], tokens: list[int]) -> None:
        self.leaves = leaves
        self._size = 1 << (len(leaves) - 1).bit_length()
        self._chars = [0] * (2 * self._size)
        self._sums = [0] * (2 * self._size)
        for i, (leaf, count) in enumerate(zip(leaves, tokens)):
            self._chars[self._size + i], self._sums[self._size + i] = len(leaf), count
        for i in range(self._size - 1, 0, -1):
            self._chars[i] = self._chars[2 * i] + self._chars[2 * i + 1]
            self._sums[i] = self._sums[2 * i] + self._sums[2 * i + 1]

    @property
    def total(self) -> int:
        """Tokens of the whole text."""
        return self._sums[1]

    @property
    def text(self) -> str:
        return "".join(self.leaves)

    def __len__(self) -> int:
        return self._chars[1]

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (the last one that has any, for the end), and where it begins."""
        node, begin = 1, 0
        while node < self._size:
            left = self._chars[2 * node]
            go = at - begin >= left and self._chars[2 * node + 1] > 0
            node, begin = 2 * node + go, begin + left * go
        return node - self._size, begin

    def _put(self, leaf: int, text: str, tokens: int) -> None:
        self.leaves[leaf] = text
        node = self._size + leaf
        chars, sums = len(text) - self._chars[node], tokens - self._sums[node]
        while node:
            self._chars[node] += chars
            self._sums[node] += sums
            node >>= 1

    def edit(self, start: int, removed: int, inserted: str) -> int:
        """Replace ``removed`` characters from ``start`` on by ``inserted``; the new total.

        Places beyond the text count as its end. Only the leaves that the edit touches are encoded again, together with
        neighbours while the boundary between them is none where a pre-token must end.
        """
        start = min(max(start, 0), len(self))
        stop = min(start + max(removed, 0), len(self))
        first, begin = self._find(start)
        last, last_begin = self._find(stop)
        tail = self.leaves[last][stop - last_begin :]
        text = self.leaves[first][: start - begin] + inserted + tail
        while (left := self._beside(first, -1)) is not None and not _joint(self.leaves[left], text):
            text, first = self.leaves[left] + text, left
        while (right := self._beside(last, 1)) is not None and not _joint(text, self.leaves[right]):
            text, last = text + self.leaves[right], right
        for leaf in range(first + 1, last + 1):
            if self.leaves[leaf]:
                self._put(leaf, "", 0)
        if len(text) > 16 * self._leaf_chars:
            self._put(first, text, 0)
            self._build(self.text)
        else:
            self._put(first, text, self._tokens(text))
        return self.total

    def _beside(self, leaf: int, step: int) -> int | None:
        at = leaf + step
        while 0 <= at < len(self.leaves):
            if self.leaves[at]:
                return at
            at += step
        return None


def _joint(left: str, right: str) -> bool:
    """Whether a pre-token must end between the two; an empty text may stand anywhere only if nothing is joined."""
    return bool(left) and bool(right) and _CUT.match(left[-1] + right[0], 1) is not None


EDIT = "array<struct<start:long,removed:long,inserted:string>>"
_TREE = "n_chars long, n_tokens long, leaf_chars array<int>, leaf_tokens array<int>"
_EDITED = f"encoded_chars long, {_TREE}"
_LISTS = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def build_trees(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", ranks: tuple[str, ...] | None = None) -> DataFrame:
    """Rows (id, text, n_chars, n_tokens, leaf_chars, leaf_tokens): every whole text with its token tree, to be kept.

    A tree is kept as its leaves' characters and tokens, from which sums follow; ``text`` is the text as UTF-8. Null texts
    count as empty (no tokens). Repeated rows keep a row each; other columns are ignored; an empty table gives an empty
    result.
    """
    small_batches(docs.sparkSession)
    ranks = ranks or rank_file()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(ranks)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                tree = TokenTree(text.decode("utf-8", "replace"), count)
                rows.append((len(tree), tree.total, *tree.state()))
            columns = zip(*rows) if rows else [()] * 4
            arrays = [pa.array(list(c), kind) for c, kind in zip(columns, _LISTS)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["id", "text", *_names(_TREE)])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("id"), utf8(text_column).alias("text")).mapInArrow(run, f"id {kind}, text binary, {_TREE}")


def apply_edits(trees: DataFrame, edits: Column, keep_text: bool = True, ranks: tuple[str, ...] | None = None) -> DataFrame:
    """Rows (id, [text,] encoded_chars, n_chars, n_tokens, leaf_chars, leaf_tokens) of texts and trees after edits.

    ``trees`` are rows of :func:`build_trees` or of this function; ``edits`` is an array of (start, removed, inserted)
    structs that apply to each text in order, in characters. ``encoded_chars`` is what had to be encoded; the rest of the
    tree is taken over. A null array is no edit; a null in an edit reads 0 or empty; places beyond a text are its end.
    """
    ranks = ranks or rank_file()
    held = ["text"] if keep_text else []

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(ranks)
        for batch in batches:
            rows = []
            for text, chars, tokens, changes in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
                tree = TokenTree.kept(text.decode("utf-8", "replace"), chars, tokens, count)
                for change in changes or []:
                    tree.edit(change["start"] or 0, change["removed"] or 0, change["inserted"] or "")
                rows.append((*([tree.text.encode("utf-8", "replace")] if keep_text else []), tree.encoded_chars, len(tree), tree.total, *tree.state()))
            kinds = [*([pa.binary()] if keep_text else []), pa.int64(), *_LISTS]
            columns = zip(*rows) if rows else [()] * len(kinds)
            arrays = [pa.array(list(c), kind) for c, kind in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["id", *held, *_names(_EDITED)])

    kind = trees.schema["id"].dataType.simpleString()
    rows = trees.select("id", "text", "leaf_chars", "leaf_tokens", edits.cast(EDIT).alias("edits"))
    return rows.mapInArrow(run, f"id {kind}, {'text binary, ' if keep_text else ''}{_EDITED}")


def revision(text: Column) -> Column:
    """A revision that every text can have: a sentence put in after a third, a stretch cut out behind the middle, and
    the first words replaced."""
    long = F.length(text).cast("long")

    def change(start: Column, removed: int, inserted: str) -> Column:
        return F.struct(start.alias("start"), F.lit(removed).cast("long").alias("removed"), F.lit(inserted).alias("inserted"))

    return F.array(
        change(F.floor(long / 3), 0, " A sentence was put in here."), change(F.floor(long / 2), 40, ""), change(F.lit(0).cast("long"), 12, "Revised:")
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, before and after a revision of three edits that the kept trees follow."""
    trees = build_trees(table(spark, sf_dir, "documents"))
    before = F.struct(F.col("id").alias("doc_id"), "n_chars", "n_tokens", F.size("leaf_chars").alias("n_leaves"))
    edited = apply_edits(trees.withColumn("id", before), revision(F.col("text").cast("string")), keep_text=False)
    return edited.select("id.*", F.col("n_chars").alias("edited_chars"), F.col("n_tokens").alias("edited_tokens"), F.col("encoded_chars").alias("reencoded_chars"))
