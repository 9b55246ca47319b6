"""Language identification by prediction by partial matching: byte context trees with escapes, statistics frozen."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffers, is_held_out, sampled, small_batches, table

#: Bytes of context of the deepest nodes.
ORDER = 3
#: Documents, and bytes of their texts, that each language's tree learns from at most; whole texts are used.
SAMPLE_DOCS, SAMPLE_BYTES = 400, 1 << 20
#: Languages whose trees share one set of nodes, for which all of them have numbers.
TOGETHER = 8
#: Bits of a byte that no context has seen: all 256 are alike.
UNSEEN_BITS = 8.0
UNKNOWN = "und"
#: Positions scored at once.
CHUNK = 1 << 19
_LETTER = regex.compile(r"\p{L}")


@dataclass
class ContextTrees:
    """The trees of some languages on one set of nodes. A node is a byte string of up to ORDER + 1 bytes that some language has seen.

    ``child[node, symbol]`` is the node of the string with one more byte, or -1; the last row is all -1, so that -1 leads
    to -1. ``cost[node, language]`` are the bits of the node's last byte after the others as context, less what
    ``escapes`` of that context holds; ``escapes[node, language]`` are the bits of escaping from the node as context and
    from all its suffixes. So a byte takes ``cost[longest seen string] + escapes[longest seen context]`` bits exactly.
    """

    languages: list[str]
    symbol: np.ndarray
    child: np.ndarray
    cost: np.ndarray
    escapes: np.ndarray


def grow(texts: dict[str, list[bytes]], order: int = ORDER) -> ContextTrees:
    """The trees of each language's texts.

    With n occurrences and d different bytes after a context, a byte seen c times has probability c / (n + d) and the
    escape to the context without its first byte d / (n + d); below the empty context all 256 bytes are alike.
    """
    languages = sorted(texts)
    used = np.zeros(256, bool)
    for parts in texts.values():
        for part in parts:
            used[np.frombuffer(part, np.uint8)] = True
    width = int(used.sum()) + 1
    symbol = np.full(256, width - 1, np.int32)
    symbol[used] = np.arange(width - 1)
    streams = []
    for at, language in enumerate(languages):
        for part in texts[language]:
            streams.append((at, symbol[np.frombuffer(part, np.uint8)].astype(np.int64)))
    tongue = np.concatenate([np.full(len(s), at) for at, s in streams]) if streams else np.empty(0, np.int64)
    symbols = np.concatenate([s for _, s in streams]) if streams else np.empty(0, np.int64)
    first = np.zeros(len(symbols), bool)
    begins = np.cumsum([0, *(len(s) for _, s in streams)])[:-1] if streams else []
    first[[b for (_, s), b in zip(streams, begins) if len(s)]] = True

    parent, last, suffix = [np.array([-1])], [np.array([-1])], [np.array([-1])]
    counts = [np.zeros((1, len(languages)))]
    total = 1
    node = np.zeros(len(symbols), np.int64)
    for level in range(1, order + 2):
        if level == 1:
            context = np.zeros(len(symbols), np.int64)
        else:
            context = np.concatenate(([-1], node[:-1])) if len(node) else node
            context[first] = -1
        shorter, node = node, np.full(len(symbols), -1, np.int64)
        here = np.flatnonzero(context >= 0)
        keys, index = np.unique(context[here] * width + symbols[here], return_inverse=True)
        node[here] = total + index
        parent.append(keys // width)
        last.append(keys % width)
        link = np.zeros(len(keys), np.int64)
        link[index] = shorter[here] if level > 1 else 0
        suffix.append(link)
        found = np.zeros((len(keys), len(languages)))
        np.add.at(found, (index, tongue[here]), 1)
        counts.append(found)
        total += len(keys)
    parent, last, suffix = (np.concatenate(x) for x in (parent, last, suffix))
    levels = np.repeat(np.arange(order + 2), [len(c) for c in counts])
    count = np.concatenate(counts)
    inner = int((levels <= order).sum())
    child = np.full((inner + 1, width), -1, np.int32)
    child[parent[1:], last[1:]] = np.arange(1, total)
    seen, kinds = np.zeros((inner, len(languages))), np.zeros((inner, len(languages)))
    np.add.at(seen, parent[1:], count[1:])
    np.add.at(kinds, parent[1:], count[1:] > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        escape = np.where(seen > 0, np.log2((seen + kinds) / kinds), 0.0)
    code = np.full((total, len(languages)), UNSEEN_BITS)
    escapes = escape.copy()
    for level in range(1, order + 2):
        own = np.flatnonzero(levels == level)
        if level <= order:
            escapes[own] += escapes[suffix[own]]
        ahead = parent[own]
        # Of a string of one byte the shorter one is no string of the tree: below it all bytes are alike.
        lower = code[suffix[own]] if level > 1 else np.full((len(own), len(languages)), UNSEEN_BITS)
        with np.errstate(divide="ignore", invalid="ignore"):
            direct = np.log2((seen[ahead] + kinds[ahead]) / count[own])
        code[own] = np.where(count[own] > 0, direct, escape[ahead] + lower)
    cost = np.empty((total + 1, len(languages)))
    cost[1:total] = code[1:] - escapes[parent[1:]]
    cost[0] = cost[total] = UNSEEN_BITS
    return ContextTrees(languages, symbol, child, cost.astype(np.float32), np.vstack([escapes, np.zeros((1, len(languages)))]).astype(np.float32))


def code_lengths(trees: ContextTrees, raw: np.ndarray, offsets: np.ndarray, order: int = ORDER, chunk: int = CHUNK) -> np.ndarray:
    """Bits that each language's tree takes for each row of ``raw`` (cut at ``offsets``).

    Positions are scored ``chunk`` at a time; a row that is cut goes on with its own last bytes as context.
    """
    out = np.zeros((len(offsets) - 1, len(trees.languages)))
    lengths = np.diff(offsets)
    child, inner = trees.child, len(trees.child) - 1
    for at in range(0, int(offsets[-1]) if len(offsets) else 0, chunk):
        stop = min(at + chunk, int(offsets[-1]))
        begin = max(at - order, 0)
        symbols = trees.symbol[raw[begin:stop]]
        rows = np.searchsorted(offsets, [begin, stop - 1], "right") - 1
        inside = offsets[rows[0] : rows[1] + 1]
        starts = inside[(inside >= begin) & (lengths[rows[0] : rows[1] + 1] > 0)] - begin
        best = child[0, symbols]
        node, context = best, np.zeros(len(symbols), np.int32)
        for _ in range(order):
            ahead = np.empty_like(node)
            ahead[1:] = node[:-1]
            ahead[:1] = -1
            ahead[starts] = -1
            known = ahead >= 0
            context = np.where(known & (ahead < inner), ahead, context)
            node = child[np.where(known, ahead, inner), symbols]
            best = np.where(node >= 0, node, best)
        bits = trees.cost[best] + trees.escapes[context]
        bits = bits[at - begin :]
        cuts = np.flatnonzero((offsets[:-1] < stop) & (offsets[1:] > at) & (lengths > 0))
        out[cuts] += np.add.reduceat(bits, np.maximum(offsets[cuts] - at, 0), axis=0, dtype=np.float64)
    return out


def has_letter(text: bytes) -> bool:
    return _LETTER.search(text.decode("utf-8", "replace")) is not None


def learn(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", sample_docs: int = SAMPLE_DOCS
) -> list[ContextTrees]:
    """The trees of a sample of rows with a language and a text, ``TOGETHER`` languages at a time: up to ``sample_docs``
    documents and ``SAMPLE_BYTES`` of each language, drawn by a hash of id and text.

    How many rows each language has is counted over all; the driver holds the sample alone. Rows without a language or
    text are passed over, rows alike in id and text count once; without rows there are no trees.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(lang_column).alias("group"), F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    rows = rows.where("group IS NOT NULL AND text IS NOT NULL")
    sizes = {r[0]: r[1] for r in rows.groupBy("group").count().collect()}
    if not sizes:
        return []
    draw = F.pmod(F.xxhash64(F.lit("language"), "id", "text"), F.lit(1_000_000))
    wanted = F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, max(1, min(1_000_000, 2_000_000 * sample_docs // n)))))
    texts = sampled(rows.where(draw < wanted[F.col("group")]), dict.fromkeys(sizes, sample_docs), SAMPLE_BYTES, "tongue")
    names = sorted(texts)
    return [grow({k: texts[k] for k in names[at : at + TOGETHER]}) for at in range(0, len(names), TOGETHER)]


def identify(docs: DataFrame, trees: list[ContextTrees], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (id, lang_pred, score): the language whose tree takes the fewest bits for the whole text.

    The score is the language's share of probability, all languages beforehand alike. Texts that are null or have no
    letter, and all texts if nothing was learned, are ``und`` with score 0; of equals the first by name wins. Repeated
    rows keep a row each; other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(trees)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        languages = [name for some in trees for name in some.languages]
        for batch in batches:
            texts = batch.column(1)
            raw, offsets = buffers(texts)
            names, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            if languages and batch.num_rows:
                bits = np.hstack([code_lengths(some, raw, offsets) for some in trees])
                best = bits.argmin(axis=1)
                ahead = bits - bits[np.arange(len(bits)), best][:, None]
                share = 1 / np.exp2(-np.minimum(ahead, 1000)).sum(axis=1)
                for i in range(batch.num_rows):
                    if has_letter(raw[offsets[i] : offsets[i + 1]].tobytes()):
                        names[i], scores[i] = languages[best[i]], share[i]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names), pa.array(scores)], names=["id", "lang_pred", "score"])

    kind = docs.schema[id_column].dataType.simpleString()
    text = F.coalesce(F.col(text_column), F.lit("")).cast("binary")
    return docs.select(F.col(id_column).alias("id"), text.alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; a quarter of the documents is held out from learning."""
    docs = table(spark, sf_dir, "documents")
    held_out = is_held_out(4, 2)
    found = identify(docs, learn(docs.where(~held_out)))
    return found.withColumnRenamed("id", "doc_id").select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
