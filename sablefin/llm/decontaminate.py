"""Benchmark decontamination with DataFrame functions alone: SimHash of item-sized windows, multi-index Hamming blocks,
and exact weighted-shingle similarity of the candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_broadcast, table, temporary, written

SHINGLE_WORDS, SIMILARITY = 5, 0.8
#: Fingerprints link at so many differing bits at most. Of windows with similarity 0.8 or more, all but some 2 in 10,000
#: are that near their item; each leak has a window for every start near it.
RADIUS = 15
#: Blocks of a fingerprint. By the pigeonhole principle some block differs in at most RADIUS // BLOCKS bits.
BLOCKS = 8
BLOCK_BITS = 64 // BLOCKS
#: So many shingles of the items may stand in the plan as literals; more are joined by shuffle.
INLINE = 8192


def words_of(text: Column) -> Column:
    """The words of a text: runs of letters and digits, lower-cased; null reads as empty."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with more columns, each computed once for a row.

    They come out of a generator of one row, below which no later filter or projection can be pushed; as plain columns,
    Catalyst would copy their expressions into filters and into lambdas, which run them again for each element.
    """
    made = F.struct(*(c.alias(name) for name, c in columns.items()))
    return df.select("*", F.explode(F.array(made)).alias("__made")).select(*df.columns, "__made.*")


def shingles_of(words: Column, size: Column) -> Column:
    """The hash of each ``size`` words on end; of all words if there are fewer."""
    least = F.least(size, F.size(words))
    starts = F.sequence(F.lit(1), F.size(words) - least + 1)
    return F.when(F.size(words) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, least))))


#: The SimHash of the array ``hashes``, repeats included: a bit is 1 if it is in over half of them.
_FINGERPRINT = """
aggregate(sequence(0, 63), 0L, (bits, k) -> bits | IF(
  2 * aggregate(hashes, 0, (n, h) -> n + CAST(shiftrightunsigned(h, k) & 1L AS INT)) > size(hashes), shiftleft(1L, k), 0L))
"""


def with_fingerprint(df: DataFrame, words: str) -> DataFrame:
    """``df`` with a column ``fp``, the SimHash of its column of words."""
    hashed = computed(df, hashes=F.transform(words, lambda w: F.xxhash64(w)))
    return computed(hashed, fp=F.expr(_FINGERPRINT)).drop("hashes")


def _blocks(name: str) -> list[Column]:
    mask = (1 << BLOCK_BITS) - 1
    return [F.shiftrightunsigned(F.col(name), BLOCK_BITS * i).bitwiseAND(F.lit(mask)).cast("int") for i in range(BLOCKS)]


def item_index(items: DataFrame) -> DataFrame:
    """Rows (item_id, n, block, value, item_fp, item_shingles): each item under every block value within reach of its own.

    ``value`` runs over all values that differ from the item's block in at most RADIUS // BLOCKS bits.
    """
    reach = RADIUS // BLOCKS
    masks = F.array(*(F.lit(m) for m in range(1 << BLOCK_BITS) if m.bit_count() <= reach))
    block = F.explode(F.array(*(F.struct(F.lit(i).alias("block"), v.alias("own")) for i, v in enumerate(_blocks("fp")))))
    rows = items.select("item_id", "n", F.col("fp").alias("item_fp"), F.col("shingles").alias("item_shingles"), block.alias("b"))
    return rows.select("item_id", "n", "item_fp", "item_shingles", "b.block", F.col("b.own").alias("own"), F.explode(masks).alias("m")).select(
        "item_id", "n", "block", F.col("own").bitwiseXOR(F.col("m")).alias("value"), "item_fp", "item_shingles"
    )


def anchors_of(items: DataFrame) -> DataFrame:
    """Rows (shingle, n, at): of each item of n words, the rarest shingles and where they stand.

    A window with similarity s shares at least s times the item's number of shingles, so it holds one of any
    (1 - s) times that number plus one of them: taking that many of each item loses no window.
    """
    each = items.select("item_id", "n", F.size("shingles").alias("many"), F.posexplode("shingles").alias("at", "shingle"))
    common = each.groupBy("shingle").agg(F.count_distinct("item_id").alias("items"))
    order = Window.partitionBy("item_id").orderBy("items", "shingle", "at")
    ranked = each.join(common, "shingle").withColumn("rank", F.row_number().over(order))
    most = F.col("many") - F.ceil(F.col("many") * F.lit(SIMILARITY)) + 1
    return ranked.where(F.col("rank") <= most).select("shingle", "n", "at").distinct()


def _hits(docs: DataFrame, anchors: DataFrame, sizes: list[int]) -> DataFrame:
    """Rows (doc_id, text_hash, words, hits): documents with the places (``at``, from 0) of the item shingles in them, and how
    many words (``reach``) the longest item has that is anchored there."""
    reaches = anchors.groupBy("shingle").agg(F.max("n").alias("reach"))
    few = sorted(map(tuple, reaches.limit(INLINE + 1).collect()))
    if not few:
        return docs.where("false").withColumn("hits", F.array().cast("array<struct<at:int,reach:int>>"))
    if len(few) <= INLINE:
        literal = lambda x: f"{x}L" if x > -(1 << 63) else "(-9223372036854775807L - 1L)"
        known = ", ".join(literal(x) for x, _ in few)
        reach = f"map_from_arrays(array({known}), array({', '.join(str(n) for _, n in few)}))"
        parts = [
            f"""IF(size(words) < {g}, CAST(array() AS array<struct<at:int,reach:int>>), transform(
                  filter(sequence(0, size(words) - {g}), i -> xxhash64(slice(words, i + 1, {g})) IN ({known})),
                  i -> named_struct('at', i, 'reach', {reach}[xxhash64(slice(words, i + 1, {g}))])))"""
            for g in sizes
        ]
        found = F.expr(parts[0] if len(parts) == 1 else f"concat({', '.join(parts)})")
        return computed(docs, hits=found)
    places = None
    for g in sizes:
        shingles = F.when(F.size("words") >= g, shingles_of(F.col("words"), F.lit(g)))
        rows = docs.select("doc_id", "text_hash", F.posexplode(shingles).alias("at", "shingle")).join(reaches, "shingle")
        places = rows if places is None else places.union(rows)
    lists = F.collect_set(F.struct("at", "reach")).alias("hits")
    grouped = written(places.groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__text")).agg(lists), "hits")
    same = lambda other: docs["doc_id"].eqNullSafe(other["__id"]) & (docs["text_hash"] == other["__text"])
    ids = bounded_broadcast(grouped.select("__id", "__text"))
    docs = docs.join(ids, same(ids), "left_semi")
    return docs.join(grouped, same(grouped)).drop("__id", "__text")


def _leaks(docs: DataFrame, benchmark: DataFrame, id_column: str, text_column: str, item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows (doc_id, text_hash, item_id, best): as :func:`contaminated`, with texts of one id apart."""
    items = benchmark.select(F.col(item_column).alias("item_id"), words_of(F.col(item_text)).alias("words")).where(F.size("words") > 0)
    items = items.select("item_id", "words", F.size("words").alias("n"), shingles_of(F.col("words"), F.lit(SHINGLE_WORDS)).alias("shingles"))
    items = written(with_fingerprint(items, "words").distinct(), "items")
    anchors = written(anchors_of(items), "anchors")
    sizes = sorted(items.agg(F.collect_set(F.least("n", F.lit(SHINGLE_WORDS)))).first()[0]) or [SHINGLE_WORDS]
    texts = computed(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")), words=words_of(F.col("text")), text_hash=F.xxhash64("text")).drop("text")
    hits = _hits(texts, anchors, sizes)
    # What a hit needs of the text goes along with it, as far as its own items reach, so no text is joined again.
    around = F.expr(f"""
      transform(hits, h -> named_struct('p', h.at, 'reach', h.reach, 'base', greatest(h.at - h.reach, 0),
                                        'near', slice(words, greatest(h.at - h.reach, 0) + 1, 2 * h.reach + {SHINGLE_WORDS})))""")
    near = hits.select("doc_id", "text_hash", F.explode_outer(around).alias("h")).where("h IS NOT NULL").select("doc_id", "text_hash", "h.*")
    keyed = None
    for g in sizes:
        own = near.withColumn("shingle", F.xxhash64(F.expr(f"slice(near, p - base + 1, {g})"))).where(F.expr(f"size(near) - (p - base) >= {g}"))
        known = anchors.where(F.least("n", F.lit(SHINGLE_WORDS)) == g).select("shingle", "n").distinct()
        found = own.join(bounded_broadcast(known), "shingle").where("n <= reach")
        keyed = found if keyed is None else keyed.union(found)
    # All windows of n words that hold the hit, but for those that hold the hit before, too.
    first = F.greatest(F.col("p") - F.col("n") + F.least("n", F.lit(SHINGLE_WORDS)), F.lit(0))
    stretch = keyed.withColumn("first", first)
    stretch = stretch.select("doc_id", "text_hash", "n", "p", "first", F.expr("slice(near, first - base + 1, p - first + n)").alias("near"))
    before = F.lag("p").over(Window.partitionBy("doc_id", "text_hash", "n").orderBy("p"))
    stretch = stretch.withColumn("from", F.greatest("first", F.coalesce(before + 1, F.lit(0)))).where(F.col("from") <= F.col("p"))
    window = F.expr("slice(near, start - first + 1, n)")
    starts = stretch.withColumn("start", F.explode(F.sequence("from", "p"))).select("doc_id", "text_hash", "n", "start", window.alias("window"))
    marked = with_fingerprint(starts.where(F.size("window") > 0), "window")
    block = F.explode(F.array(*(F.struct(F.lit(i).alias("block"), v.alias("value"), F.col("fp").alias("own_fp")) for i, v in enumerate(_blocks("fp")))))
    index = bounded_broadcast(written(item_index(items), "item-blocks"), 1 << 15)
    met = marked.withColumn("b", block).select("doc_id", "text_hash", "n", "start", "window", "b.*").join(index, ["n", "block", "value"])
    apart = F.col("own_fp").bitwiseXOR(F.col("item_fp"))
    # A pair may meet in several blocks; the first one counts.
    first = F.coalesce(*(F.when(F.bit_count(x) <= RADIUS // BLOCKS, i) for i, x in enumerate(_blocks("apart"))))
    near_by = met.withColumn("apart", apart).where((F.bit_count("apart") <= RADIUS) & (F.col("block") == first))
    near_by = near_by.select("doc_id", "text_hash", "item_id", "n", "start", "window", F.bit_count("apart").alias("distance"), "item_shingles")
    shingled = computed(near_by, own=shingles_of(F.col("window"), F.least(F.col("n"), F.lit(SHINGLE_WORDS))), size=F.size("window"))
    shared = F.expr("""
      aggregate(array_distinct(item_shingles), 0, (n, x) -> n + least(size(filter(own, y -> y = x)), size(filter(item_shingles, y -> y = x))))""")
    scored = computed(shingled, shared=shared)
    scored = scored.withColumn("similarity", F.col("shared") / (F.size("own") + F.size("item_shingles") - F.col("shared")))
    best = scored.where(F.col("similarity") >= SIMILARITY).groupBy("doc_id", "text_hash", "item_id")
    return best.agg(F.min(F.struct((-F.col("similarity")).alias("minus"), "start", "size", "distance")).alias("best"))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """Rows (doc_id, item_id, start_word, n_words, distance, similarity): each document's best window for each item it leaks.

    Windows have as many words as an item (fewer at a document's end) and hold one of the item's rarest shingles, wherever
    in the window it stands, as blocks of an item may have changed places; other windows can't be similar.
    A window's SimHash, over its words, meets the items of its size whose fingerprint differs by at most ``RADIUS`` bits
    (blocks guarantee that all are found), and a candidate leaks if the similarity of their shingles of five words,
    weighted by how often each occurs (sum of minima over sum of maxima), is at least 0.8. An item below five words is one
    shingle: its words must stand there exactly.

    Null or empty texts leak nothing, items without words are never leaked. Rows that repeat an id (null is an id, too)
    give one row for each item, as do equal items with other ids. Other columns are ignored; empty tables give an empty
    result.
    """
    with temporary() as keep:
        found = _leaks(docs, benchmark, id_column, text_column, item_column, item_text)
        best = found.groupBy("doc_id", "item_id").agg(F.min("best").alias("best"))
        best = best.select(
            "doc_id", "item_id", F.col("best.start").alias("start_word"), F.col("best.size").alias("n_words"), "best.distance", (-F.col("best.minus")).alias("similarity")
        )
        return keep(written(best, "leaks"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` without those that leak an item of ``benchmark``; all columns stay.

    A row goes by its id (null is an id, too) and its text, so other texts of an id stay and repeated rows go together. Null
    and empty texts stay, as do all rows if the benchmark is empty; an empty table stays empty.
    """
    with temporary() as keep:
        found = _leaks(docs, benchmark, id_column, text_column).select(F.col("doc_id").alias("__gone"), F.col("text_hash").alias("__text")).distinct()
        found = keep(written(found, "leaks"))
    same = docs[id_column].eqNullSafe(found["__gone"]) & (F.xxhash64(docs[text_column]) == found["__text"])
    return docs.join(bounded_broadcast(found), same, "left_anti")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that leak a benchmark item, with the item and the best window."""
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start_word", "n_words", F.round("similarity", 6).alias("similarity"))


#: Every window of every document that shares a shingle with an item.
OP1_SQL = r"""
WITH items AS (
  SELECT item_id, words, len(words) AS n, least(len(words), 5) AS g
  FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS words FROM benchmark) WHERE len(words) > 0
), item_shingles AS (
  SELECT item_id, n, g, list_transform(range(1, n - g + 2), lambda i: array_to_string(words[i:i + g - 1], ' ')) AS s FROM items
), docs AS (
  SELECT doc_id, words, len(words) AS m FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS words FROM documents)
), doc_shingles AS (
  SELECT doc_id, m, g, list_transform(range(1, m - g + 2), lambda i: array_to_string(words[i:i + g - 1], ' ')) AS s
  FROM docs, (SELECT DISTINCT g FROM items) WHERE m >= g
), met AS (
  SELECT d.doc_id, i.item_id FROM (SELECT doc_id, g, unnest(list_distinct(s)) AS x FROM doc_shingles) d
  JOIN (SELECT item_id, g, len(list_distinct(s)) AS kinds, len(s) AS many, unnest(list_distinct(s)) AS x FROM item_shingles) i ON i.x = d.x AND i.g = d.g
  GROUP BY d.doc_id, i.item_id
), starts AS (
  SELECT t.doc_id, t.item_id, i.n, i.g, i.s AS item_s, d.m, d.s AS doc_s, unnest(range(0, d.m)) AS start_word
  FROM met t JOIN item_shingles i ON i.item_id = t.item_id JOIN doc_shingles d ON d.doc_id = t.doc_id AND d.g = i.g
), windows AS (
  SELECT doc_id, item_id, start_word, least(n, m - start_word) AS n_words, item_s, doc_s[start_word + 1:start_word + least(n, m - start_word) - g + 1] AS own
  FROM starts WHERE m - start_word >= g
), shared AS (
  SELECT doc_id, item_id, start_word, n_words, len(item_s) AS a, len(own) AS b,
         list_sum(list_transform(list_distinct(item_s), lambda x: least(len(list_filter(own, lambda y: y = x)), len(list_filter(item_s, lambda y: y = x))))) AS alike
  FROM windows WHERE list_has_any(own, item_s)
), best AS (
  SELECT doc_id, item_id, min({'minus': -(alike / (a + b - alike)), 'start': start_word, 'size': n_words}) AS w FROM shared GROUP BY 1, 2
)
SELECT doc_id, item_id, w.start AS start_word, w.size AS n_words, round(-w.minus, 6) AS similarity FROM best WHERE -w.minus >= 0.8
"""
