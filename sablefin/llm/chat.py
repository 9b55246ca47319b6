"""Collapse of cumulative conversation snapshots, and chat rendering of what remains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table

#: Turns that one sorted block of a conversation holds; longer conversations are scanned in several blocks.
BLOCK_TURNS = 1024
TURN_OPEN, TURN_CLOSE = "<|im_start|>", "<|im_end|>"


def _parts(name: str) -> list[Column]:
    """What a column adds to a hash: whether it is null, beside its value, so that no value stands for null."""
    return [F.col(name).isNull(), F.coalesce(F.col(name), F.lit(""))]


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, n, h0..h3): the rolling hash of each conversation up to and with each turn number.

    The hash adds up the four 32-bit parts of two 64-bit hashes of (turn, role, text) rows, so it can be rolled forward,
    and rows that share a turn number need no order. A conversation is scanned in blocks of ``BLOCK_TURNS`` turn numbers
    whose totals are then added up, so that no long conversation has to be sorted by one task.
    """
    wide = [F.xxhash64(F.lit(salt), "turn", *_parts("role"), *_parts("text")) for salt in (1, 2)]
    low = F.lit(0xFFFFFFFF)
    parts = [wide[0].bitwiseAND(low), F.shiftrightunsigned(wide[0], 32), wide[1].bitwiseAND(low), F.shiftrightunsigned(wide[1], 32)]
    sums = [F.count("*").alias("n"), *(F.sum(f"p{i}").alias(f"h{i}") for i in range(4))]
    names = ["n", "h0", "h1", "h2", "h3"]
    each = turns.select("conv_id", "turn", *(p.alias(f"p{i}") for i, p in enumerate(parts))).groupBy("conv_id", "turn").agg(*sums)
    each = each.withColumn("block", F.floor(F.col("turn") / BLOCK_TURNS))
    inside = Window.partitionBy("conv_id", "block").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    rolled = each.select("conv_id", "turn", "block", *(F.sum(c).over(inside).alias(c) for c in names))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = each.groupBy("conv_id", "block").agg(*(F.sum(c).alias(c) for c in names))
    offsets = totals.select("conv_id", "block", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in names))
    joined = rolled.join(offsets, ["conv_id", "block"])
    return joined.select("conv_id", "turn", *((F.col(c) + F.col(f"{c}_before")).alias(c) for c in names))


def maximal(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, n_turns, copies): conversations that are no proper prefix of another logged conversation.

    Of equal conversations the one with the smallest id stays and ``copies`` counts them all.
    """
    hashes = prefix_hashes(turns)
    key = ["n", "h0", "h1", "h2", "h3"]
    # The whole conversation's hash is the one with most rows: sums only grow along a conversation.
    whole = hashes.groupBy("conv_id").agg(F.max(F.struct(*key)).alias("last")).select("conv_id", "last.*")
    kept = whole.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    ends = whole.select("conv_id", F.col("n").alias("n_all"))
    inner = hashes.join(ends, "conv_id").where("n < n_all").select(*key).distinct()
    return kept.join(inner, key, "left_anti").select("conv_id", F.col("n").alias("n_turns"), "copies")


def render(turns: DataFrame, kept: DataFrame) -> DataFrame:
    """``kept`` with a column ``rendered``: the conversation's turns in order, each between chat markers.

    ``<|`` inside a text is written ``< |``, so no text can open or close a turn. A null role reads ``unknown``, a null
    text is empty. Turns with equal numbers are ordered by role and text.
    """
    rows = turns.select(F.col("conv_id"), F.struct("turn", "role", "text").alias("t")).join(kept.select("conv_id"), "conv_id", "left_semi")
    lists = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))

    def one(t: Column) -> Column:
        safe = F.replace(F.coalesce(t["text"], F.lit("")), F.lit("<|"), F.lit("< |"))
        return F.concat(F.lit(TURN_OPEN), F.coalesce(t["role"], F.lit("unknown")), F.lit("\n"), safe, F.lit(TURN_CLOSE + "\n"))

    return kept.join(lists, "conv_id").select(*kept.columns, F.array_join(F.transform("ts", one), "").alias("rendered"))


def collapse_and_render(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, n_turns, copies, rendered) of the maximal conversations among rows (conv_id, turn, role, text).

    A conversation is the multiset of its (turn, role, text) rows; it is dropped if it equals the turns of another one up
    to some turn number before that one's last. Rows with a null conv_id or turn belong to no conversation and are left
    out; null roles and texts are values of their own; empty texts stay; other columns are ignored; an empty table gives an
    empty result.
    """
    turns = conversations.select("conv_id", "turn", "role", "text").where("conv_id IS NOT NULL AND turn IS NOT NULL")
    return render(turns, maximal(turns))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maximal logged conversations, rendered."""
    return collapse_and_render(table(spark, sf_dir, "conversations"))


OP10_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, role, text,
         turn || ',' || coalesce(length(role) || ':' || role, '-') || ',' || coalesce(length(text) || ':' || text, '-') || ';' AS piece
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), rolled AS (
  SELECT conv_id, turn, max(turn) OVER (PARTITION BY conv_id) AS last_turn,
         string_agg(piece, '') OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS so_far
  FROM t
), whole AS (
  SELECT conv_id, string_agg(piece, '' ORDER BY turn, role, text) AS so_far, count(*) AS n_turns,
         string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || replace(coalesce(text, ''), '<|', '< |')
                    || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text) AS rendered
  FROM t GROUP BY conv_id
), kept AS (
  SELECT so_far, min(conv_id) AS conv_id, count(*) AS copies FROM whole GROUP BY so_far
)
SELECT k.conv_id, w.n_turns, k.copies, w.rendered
FROM kept k JOIN whole w ON w.conv_id = k.conv_id
WHERE NOT EXISTS (SELECT 1 FROM rolled r WHERE r.turn < r.last_turn AND r.so_far = k.so_far)
"""
