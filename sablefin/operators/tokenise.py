"""Reversible tokenisation: three engines, their dictionaries, and the way back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sablefin.functions.patterns import NECESSARY, TEXT_RULES, TOKEN_PREFIXES, WITHIN_WORDS, Pattern, PatternSet
from sablefin.functions.validators import MAX_MATCHES, MAX_TEXT_BYTES, cards, emails, guarded
from sablefin.sources.scratch import written

#: Stands for a match of rule k while later rules run: the k-th private-use character, which no rule matches.
_FIRST_MARK = 0xE000
#: Stands before a character of the text itself that is a mark, which another private-use character then replaces.
_ESCAPE, _FIRST_ESCAPED, _ESCAPED_ESCAPE = "\uf8ff", 0xF700, "\uf7ff"
TOKEN_REGEX = r"\[[A-Z0-9_]+-\d+\]"
BOUNDED_REGEX = r"\b(?:EMAIL_|SSN_|PHONE_|CC_|IP_|LITERAL_)?[0-9A-F]{8}\b"
#: What looks like a token in a text that holds none yet gets a token of this kind, so that it comes back as it was.
LITERAL = "LITERAL"
#: What looks like a token has one of these.
_NEEDED_BY_TOKENS = r"[0-9]\]|[0-9A-F]{8}"


def _mark(k: int) -> str:
    return chr(_FIRST_MARK + k)


def _escapes(count: int) -> list[tuple[str, str]]:
    pairs = [(_mark(k), _ESCAPE + chr(_FIRST_ESCAPED + k)) for k in range(count)]
    return [(_ESCAPE, _ESCAPE + _ESCAPED_ESCAPE), *pairs]


def _escaped(text: Column, count: int) -> Column:
    """``text`` without any of the first ``count`` marks; what stands for them has no mark and is no word character either."""
    out = text
    for plain, stands_for in _escapes(count):
        out = F.replace(out, F.lit(plain), F.lit(stands_for))
    return F.when(text.rlike(f"[{_mark(0)}-{_mark(0xFF)}{_ESCAPE}]"), out).otherwise(text)


def _unescaped(text: Column, count: int) -> Column:
    out = text
    for plain, stands_for in reversed(_escapes(count)):
        out = F.replace(out, F.lit(stands_for), F.lit(plain))
    return F.when(text.contains(_ESCAPE), out).otherwise(text)


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _rules(patterns: PatternSet) -> list[Pattern]:
    """One rule for each kind in order of priority, behind one for what looks like a token of these kinds in the text itself."""
    own = PatternSet(patterns).one_per_type().by_priority()
    prefixes = "|".join(sorted({TOKEN_PREFIXES[r.pattern_type] for r in own if r.pattern_type in TOKEN_PREFIXES} | {f"{LITERAL}_"}))
    bare = "?" if any(r.pattern_type not in TOKEN_PREFIXES for r in own) else ""
    return [Pattern(LITERAL, rf"{TOKEN_REGEX}|\b(?:{prefixes}){bare}[0-9A-F]{{8}}\b"), *own]


def marked(text: Column, rules: list[Pattern]) -> Column:
    """The text with a mark for each match, and each rule's matches in order, as a struct (text, found).

    A rule sees the text that the rules before it have left, so nothing is matched twice; and each runs once, and only over texts
    that may have something for it.
    """

    def step(k: int, regex: str) -> Callable[[Column], Column]:
        def after(seen: Column) -> Column:
            worth = _may_match(seen["text"], regex)
            found = F.when(worth, F.regexp_extract_all(seen["text"], F.lit(regex), F.lit(0))).otherwise(F.array().cast("array<string>"))
            left = F.when(worth, F.regexp_replace(seen["text"], regex, _mark(k))).otherwise(seen["text"])
            return F.struct(left.alias("text"), F.concat(seen["found"], F.array(found)).alias("found"))

        return after

    out = F.struct(_escaped(text, len(rules)).alias("text"), F.array().cast("array<array<string>>").alias("found"))
    for k, rule in enumerate(rules):
        out = _once(out, step(k, rule.regex))
    plain = lambda seen: F.transform(seen["found"], lambda f: F.transform(f, lambda m: _unescaped(m, len(rules))))
    return _once(out, lambda seen: F.struct(seen["text"].alias("text"), plain(seen).alias("found")))


def _seen(found: Column) -> Column:
    """(rule, position, original) of every match, of the matches of each rule."""
    each = lambda f, k: F.transform(f, lambda m, i: F.struct(k.alias("rule"), i.alias("position"), m.alias("original")))
    return F.flatten(F.transform(found, each))


def _places(df: DataFrame, key: str, text_column: str, patterns: PatternSet) -> DataFrame:
    """Rows (key, rule, position, original) of every match."""
    marks = df.select(F.col(key).alias("key"), marked(F.col(text_column), _rules(patterns)).alias("__marks"))
    return marks.select("key", F.explode(_seen(F.col("__marks.found"))).alias("at")).select("key", "at.*")


def places(df: DataFrame, text_column: str, patterns: PatternSet) -> DataFrame:
    """Rows (original, pattern_type) of every match in the texts, repeats included."""
    names = F.array(*(F.lit(r.pattern_type) for r in _rules(patterns)))
    seen = df.select(marked(F.col(text_column), _rules(patterns)).alias("__marks")).select(F.explode(_seen(F.col("__marks.found"))).alias("at"))
    return seen.select("at.original", F.element_at(names, F.col("at.rule") + 1).alias("pattern_type"))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with consecutive numbers from 0 along ``order``, which must tell all rows apart.

    Rows are range-partitioned and numbered within their partition; only the partitions' sizes are added up in one place.
    The partitioned rows are written first: the bounds of a range partitioning come from a sample, so a second one for the
    sizes could differ.
    """
    dealt = written(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "numbered")
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__size"))
    before = F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.withColumn("__before", before).select("__part", "__before")  # a row for each partition
    joined = dealt.withColumn("__inside", inside).join(F.broadcast(offsets), "__part")
    return joined.withColumn(name, F.col("__before") + F.col("__inside") - 1).drop("__part", "__inside", "__before")


def dictionary(df: DataFrame, key: str, text_column: str, patterns: PatternSet) -> DataFrame:
    """Rows (original, pattern_type, number): each distinct match, numbered from 0 by its first place.

    Places are ordered by key, then rule by priority, then position; a text that several kinds match has the kind of its
    first place. What looks like a token in a text is an original of its own, so no text can pass for another one's token.
    """
    names = F.array(*(F.lit(r.pattern_type) for r in _rules(patterns)))
    places = _places(df, key, text_column, patterns)
    first = places.groupBy("original").agg(F.min(F.struct("key", "rule", "position")).alias("at"))
    rows = first.select("original", F.element_at(names, F.col("at.rule") + 1).alias("pattern_type"), "at.key", "at.rule", "at.position")
    return numbered(rows, ["key", "rule", "position"], "number").select("original", "pattern_type", "number")


def counter_token(pattern_type: Column, number: Column) -> Column:
    """``[LABEL-n]``."""
    return F.concat(F.lit("["), pattern_type, F.lit("-"), number.cast("string"), F.lit("]"))


def bounded_token(pattern_type: Column, number: Column) -> Column:
    """A prefix for the kind (none for some) and the number as eight hexadecimal digits."""
    pairs = [F.lit(x) for item in (TOKEN_PREFIXES | {LITERAL: f"{LITERAL}_"}).items() for x in item]
    return F.concat(F.coalesce(F.create_map(*pairs)[pattern_type], F.lit("")), F.format_string("%08X", number))


def hash_token(original: Column, label: str | Column) -> Column:
    """``[LABEL-h]`` with 60 bits of a hash of text and label: no dictionary is needed to make it."""
    before, behind = (F.lit(f"[{label}-"), F.lit(f"|{label}")) if isinstance(label, str) else (F.concat(F.lit("["), label, F.lit("-")), F.concat(F.lit("|"), label))
    digest = F.conv(F.substring(F.md5(F.concat(original, behind)), 1, 15), 16, 10)
    return F.concat(before, digest, F.lit("]"))


def tokenise(df: DataFrame, key: str, text_column: str, tokens: DataFrame, patterns: PatternSet) -> DataFrame:
    """``df`` with its text tokenised and the column ``tokens_used``, from a dictionary with columns original and token.

    Only documents with a match meet the dictionary; a frequent original is a skewed join key, which AQE splits. The
    matches' tokens then take the marks' places in order. Null keys are keys like any other, rows may repeat a key, and
    characters that serve as marks may stand in a text. A match without a token in the dictionary is an error: it can
    neither stay nor go.
    """
    return tokenise_columns(df, key, [text_column], tokens, patterns)


def record_dictionary(df: DataFrame, key: str, columns: list[str], patterns: PatternSet) -> DataFrame:
    """:func:`dictionary` of several text columns at once: a row's columns count as places in the order given."""
    cells = F.array(*(F.struct(F.struct(F.col(key).alias("row"), F.lit(i).alias("column")).alias("place"), F.col(c).alias("value")) for i, c in enumerate(columns)))
    return dictionary(df.select(F.explode(cells).alias("cell")).select("cell.*"), "place", "value", patterns)


def tokenise_columns(df: DataFrame, key: str, columns: list[str], tokens: DataFrame, patterns: PatternSet) -> DataFrame:
    """``df`` with all the given text columns tokenised, and the tokens used in any of them in ``tokens_used``.

    The matches of all columns meet the dictionary in one join, and their rows in another one.
    """
    rules = _rules(patterns)
    each = {c: f"__marks_{i}" for i, c in enumerate(columns)}
    marks = df.select("*", F.col(key).alias("__row"), *(marked(F.col(c), rules).alias(m) for c, m in each.items()))
    originals = F.array_distinct(F.flatten(F.array(*(F.flatten(F.col(f"{m}.found")) for m in each.values()))))
    used = marks.select(F.col("__row").alias("key"), F.explode(originals).alias("original")).join(tokens.select("original", "token"), "original")
    maps = used.groupBy("key").agg(F.map_from_entries(F.collect_set(F.struct("original", "token"))).alias("__tokens"))
    maps = maps.withColumnRenamed("key", "__key")
    joined = marks.drop(*columns).join(maps, F.col("__row").eqNullSafe(F.col("__key")), "left")
    missing = F.raise_error(F.lit("a match has no token in the dictionary")).cast("string")
    signs = F.array(*(F.lit(_mark(k)) for k in range(len(rules))))

    def filled(found: Column) -> Callable[[Column, Column], Column]:
        def step(text: Column, k: Column) -> Column:
            own = F.transform(F.get(found, k), lambda m: F.coalesce(F.col("__tokens")[m], missing))
            pieces = F.zip_with(F.split(text, F.get(signs, k), -1), own, lambda p, t: F.concat(p, F.coalesce(t, F.lit(""))))
            return F.when(F.size(F.get(found, k)) > 0, F.array_join(pieces, "")).otherwise(text)

        return step

    done = {}
    for c, m in each.items():
        out = F.aggregate(F.sequence(F.lit(0), F.lit(len(rules) - 1)), F.col(f"{m}.text"), filled(F.col(f"{m}.found")))
        done[c] = _once(out, lambda text: _unescaped(text, len(rules))).alias(c)
    in_order = F.array_distinct(F.transform(F.flatten(F.array(*(F.flatten(F.col(f"{m}.found")) for m in each.values()))), lambda m: F.col("__tokens")[m]))
    return joined.select(*(done.get(c, F.col(c)) for c in df.columns), F.coalesce(in_order, F.array().cast("array<string>")).alias("tokens_used"))


def merged_dictionary(known: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (original, pattern_type, number): a dictionary that was kept, with the originals of ``found`` that it lacks.

    What is known keeps its number and kind; new originals get the numbers behind the largest known one, in their order.
    """
    fresh = found.join(known.select("original"), "original", "left_anti").select("original", "pattern_type", F.col("number").alias("place"))
    last = known.agg((F.coalesce(F.max("number"), F.lit(-1)) + 1).alias("__next"))  # one row
    fresh = numbered(fresh, ["place", "original"], "number").crossJoin(F.broadcast(last))
    return known.select("original", "pattern_type", "number").union(fresh.select("original", "pattern_type", F.col("number") + F.col("__next")))


def detokenise(df: DataFrame, key: str, text_column: str, tokens: DataFrame, regex: str = TOKEN_REGEX) -> DataFrame:
    """``df`` with the tokens of a dictionary replaced by their originals; unknown tokens stay."""
    found = df.select(F.col(key).alias("key"), F.explode(F.array_distinct(F.regexp_extract_all(text_column, F.lit(regex), F.lit(0)))).alias("token"))
    known = found.join(tokens.select("token", "original"), "token")
    maps = known.groupBy("key").agg(F.collect_set(F.struct("token", "original")).alias("__pairs"))
    maps = maps.withColumnRenamed("key", "__key")
    joined = df.join(maps, df[key].eqNullSafe(maps["__key"]), "left").drop("__key")
    return joined.withColumn(text_column, _restored(F.col(text_column), F.col("__pairs"), regex)).drop("__pairs")


def _restored(text: Column, pairs: Column, regex: str) -> Column:
    """One pass over the text's tokens, so that a restored original is never searched again."""

    def whole(lookup: Column) -> Column:
        own = F.transform(F.regexp_extract_all(text, F.lit(regex), F.lit(0)), lambda t: F.coalesce(lookup[t], t))
        pieces = F.zip_with(F.split(text, regex, -1), own, lambda p, t: F.concat(p, F.coalesce(t, F.lit(""))))
        return F.array_join(pieces, "")

    return F.when(pairs.isNotNull(), _once(F.map_from_entries(pairs), whole)).otherwise(text)


def _replaced(text: Column, matches: Column, label: str) -> Column:
    """Every occurrence of each match replaced by its hash token, also inside longer words."""
    return F.aggregate(F.array_distinct(matches), text, lambda acc, m: F.replace(acc, m, hash_token(m, label)))


def _may_match(text: Column, regex: str) -> Column:
    """Whether a text has what a rule's matches must have, if that is known: most texts have nothing of the kind."""
    needed = _NEEDED_BY_TOKENS if regex.startswith(f"{TOKEN_REGEX}|") else NECESSARY.get(regex)
    if needed is None:
        return F.lit(True)
    return text.contains(needed) if needed.isalpha() or needed == "@" else text.rlike(needed)


def _matches(text: Column, regex: str, most: int | None) -> Column:
    """A text's matches, the first ``most`` of them, or, if all count, all different ones in order of their first places."""
    sign = WITHIN_WORDS.get(regex)
    if most is None and sign is not None:  # only words that may match are searched, and equal ones once
        words = F.array_distinct(F.filter(F.split(text, " "), lambda w: w.contains(sign)))
        return F.flatten(F.transform(words, lambda w: F.regexp_extract_all(w, F.lit(regex), F.lit(0))))
    found = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    return found if most is None else F.slice(found, 1, most)


def tokenise_text(text: Column, rules: list[tuple[str, str]] = TEXT_RULES, most_bytes: int | None = MAX_TEXT_BYTES, most_matches: int | None = MAX_MATCHES) -> Column:
    """The text engine: rules in file order, literal replacement of each rule's matches.

    Texts above ``most_bytes`` stay as they are, and of each rule so many matches count; both guards are off (None) where
    nothing may be left in a text.
    """

    def step(label: str, regex: str) -> Callable[[Column], Column]:
        return lambda acc: F.when(_may_match(acc, regex), _replaced(acc, _matches(acc, regex, most_matches), label)).otherwise(acc)

    out = text
    for label, regex in rules:
        out = _once(out, step(label, regex))
    return out if most_bytes is None else guarded(text, out, most_bytes)


def tokenise_secure(text: Column, rules: list[tuple[str, str]] = TEXT_RULES, most_bytes: int | None = MAX_TEXT_BYTES, most_matches: int | None = MAX_MATCHES) -> Column:
    """The validating engine: valid addresses, then cards that pass the Luhn check, then the other rules' matches, which
    are all collected before any is replaced. The guards are those of :func:`tokenise_text`."""
    others = [(label, regex) for label, regex in rules if label != "EMAIL" and "CREDIT" not in label and "CARD" not in label]

    def step(base: Column, label: str, regex: str) -> Callable[[Column], Column]:
        return lambda acc: F.when(_may_match(base, regex), _replaced(acc, _matches(base, regex, most_matches), label)).otherwise(acc)

    def rest(base: Column) -> Column:
        out = base
        for label, regex in others:
            out = _once(out, step(base, label, regex))
        return out

    after_emails = F.when(text.contains("@"), _replaced(text, emails(text), "EMAIL")).otherwise(text)
    after_cards = _once(after_emails, lambda t: F.when(t.rlike("[0-9]{4}"), _replaced(t, cards(t), "CREDIT_CARD")).otherwise(t))
    out = _once(after_cards, rest)
    return out if most_bytes is None else guarded(text, out, most_bytes)


def hidden(df: DataFrame, text_column: str, rules: list[tuple[str, str]]) -> DataFrame:
    """``df`` with what any of the rules (label, regex) matches in the text replaced by hash tokens.

    Rules go in the order given, each over what the ones before it have left; of a kind there may be several. Nothing that a
    rule puts in is matched by a later one, and there are no guards.
    """
    count = len(rules)
    rows = df.withColumn("__marked", _escaped(F.col(text_column), count))
    for k, (_, regex) in enumerate(rules):  # a projection for each rule: nested in one, every rule would run all before it again
        worth = _may_match(F.col("__marked"), regex)
        found = F.when(worth, F.regexp_extract_all("__marked", F.lit(regex), F.lit(0)))
        text = F.when(worth, F.regexp_replace("__marked", regex, _mark(k))).otherwise(F.col("__marked"))
        rows = rows.select(*(c for c in rows.columns if c != "__marked"), text.alias("__marked"), found.alias(f"__found_{k}"))
    matches = F.array(*(F.col(f"__found_{k}") for k in range(count))) if rules else F.array().cast("array<array<string>>")
    rows = rows.withColumn("__found", matches).drop(*(f"__found_{k}" for k in range(count)))
    labels = F.array(*(F.lit(label) for label, _ in rules)) if rules else F.array().cast("array<string>")
    marks = F.array(*(F.lit(_mark(k)) for k in range(count))) if rules else F.array().cast("array<string>")

    def filled(text: Column, k: Column) -> Column:
        own = F.transform(F.get("__found", k), lambda m: hash_token(_unescaped(m, count), F.get(labels, k)))
        pieces = F.zip_with(F.split(text, F.get(marks, k), -1), own, lambda p, t: F.concat(p, F.coalesce(t, F.lit(""))))
        return F.when(F.size(own) > 0, F.array_join(pieces, "")).otherwise(text)

    out = F.aggregate(F.sequence(F.lit(0), F.lit(count - 1)), F.col("__marked"), filled) if rules else F.col("__marked")
    return rows.withColumn(text_column, _unescaped(out, count)).drop("__marked", "__found")


def text_tokens(df: DataFrame, text_column: str, rules: list[tuple[str, str]] = TEXT_RULES, most_bytes: int | None = MAX_TEXT_BYTES, most_matches: int | None = MAX_MATCHES) -> DataFrame:
    """Rows (original, label, token): the text engine's dictionary, one row for each distinct match."""
    text = F.col(text_column)

    def rows(label: str, regex: str) -> Column:
        return F.transform(_matches(text, regex, most_matches), lambda m: F.struct(m.alias("original"), F.lit(label).alias("label"), hash_token(m, label).alias("token")))

    parts = [rows(label, regex) for label, regex in rules]
    short = df if most_bytes is None else df.where(F.octet_length(text) <= most_bytes)
    return short.select(F.explode(F.concat(*parts)).alias("x")).select("x.*").distinct()


def tokenise_nested(
    column: Column, schema: T.DataType, rules: list[tuple[str, str]] = TEXT_RULES, most_bytes: int | None = MAX_TEXT_BYTES, most_matches: int | None = MAX_MATCHES
) -> Column:
    """The same value with every string leaf tokenised: structs, arrays and map values are walked by their type, names,
    map keys, numbers and nulls stay. JSON whose shape no schema tells goes through :func:`tokenise_json` or, as VARIANT,
    :func:`tokenise_variant`. The guards are those of :func:`tokenise_text`."""

    def walk(value: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StringType):
            return tokenise_text(value, rules, most_bytes, most_matches)
        if isinstance(kind, T.VariantType):
            return tokenise_variant(value, rules, most_bytes, most_matches)
        if isinstance(kind, T.StructType):
            parts = [walk(value[f.name], f.dataType).alias(f.name) for f in kind.fields]
            return F.when(value.isNotNull(), F.struct(*parts))
        if isinstance(kind, T.ArrayType):
            return F.transform(value, lambda x: walk(x, kind.elementType))
        if isinstance(kind, T.MapType):
            return F.transform_values(value, lambda _, v: walk(v, kind.valueType))
        return value

    return walk(column, schema)


#: A string of JSON text with the colon that makes it a name. Possessive, so that long strings take no stack.
_JSON_STRING = r'"(?:[^"\\]++|\\.)*+"(?:\s*+:)?'


def _decoded(literal: Column) -> Column:
    """What a JSON string literal stands for."""
    return F.from_json(F.concat(F.lit("["), literal, F.lit("]")), "array<string>")[0]


def _encoded(text: Column) -> Column:
    """A text as JSON string literal."""
    array = F.to_json(F.array(text))
    return F.substring(array, F.lit(2), F.length(array) - 2)


def json_leaves(text: Column) -> Column:
    """The string values of a JSON text at any depth, in order; a text that isn't JSON is a single one, null has none."""
    found = F.filter(F.regexp_extract_all(text, F.lit(_JSON_STRING), F.lit(0)), lambda x: ~x.endswith(":"))
    return F.when(F.try_parse_json(text).isNotNull(), F.transform(found, _decoded)).when(text.isNotNull(), F.array(text))


def tokenise_json(text: Column, rules: list[tuple[str, str]] = TEXT_RULES, most_bytes: int | None = MAX_TEXT_BYTES, most_matches: int | None = MAX_MATCHES) -> Column:
    """JSON text of any shape with every string value tokenised, at any depth; no schema is needed.

    Names, numbers, booleans, nulls, blanks, order and repeated names stay as they are written, and so does the notation of a
    string that nothing changes. A text that isn't JSON is tokenised as a whole; null stays null. The guards hold for each
    string. One pass over the text, without a shuffle.
    """

    def leaf(literal: Column) -> Column:
        def changed(value: Column) -> Column:
            return _once(tokenise_text(value, rules, most_bytes, most_matches), lambda done: F.when(done == value, literal).otherwise(_encoded(done)))

        return F.when(literal.endswith(":"), literal).otherwise(F.coalesce(_once(_decoded(literal), changed), literal))

    def rebuilt(whole: Column) -> Column:
        strings = F.transform(F.regexp_extract_all(whole, F.lit(_JSON_STRING), F.lit(0)), leaf)
        pieces = F.zip_with(F.split(whole, _JSON_STRING, -1), strings, lambda p, t: F.concat(p, F.coalesce(t, F.lit(""))))
        return F.array_join(pieces, "")

    return F.when(F.try_parse_json(text).isNotNull(), rebuilt(text)).otherwise(tokenise_text(text, rules, most_bytes, most_matches))


def tokenise_variant(
    value: Column, rules: list[tuple[str, str]] = TEXT_RULES, most_bytes: int | None = MAX_TEXT_BYTES, most_matches: int | None = MAX_MATCHES
) -> Column:
    """A VARIANT value with every string in it tokenised: as :func:`tokenise_json` on its JSON text, parsed again."""
    return F.parse_json(tokenise_json(F.to_json(value), rules, most_bytes, most_matches))


def record_id(df: DataFrame) -> Column:
    """The first of the columns ``id``, ``customer_id`` and ``_id`` that is there, if it is a string."""
    for name in ("id", "customer_id", "_id"):
        if name in df.columns:
            return F.col(name) if isinstance(df.schema[name].dataType, T.StringType) else F.lit(None).cast("string")
    return F.lit(None).cast("string")


def tokenise_records(
    df: DataFrame, columns: list[str], rules: list[tuple[str, str]] = TEXT_RULES, most_bytes: int | None = MAX_TEXT_BYTES, most_matches: int | None = MAX_MATCHES
) -> DataFrame:
    """Rows (id, *columns, tokens_used): records with all their string columns tokenised and the tokens in them."""
    changed = [tokenise_text(F.col(c), rules, most_bytes, most_matches).alias(c) for c in columns]
    out = df.select(record_id(df).alias("__id"), *changed)
    used = F.array_distinct(F.flatten(F.array(*(F.regexp_extract_all(c, F.lit(TOKEN_REGEX), F.lit(0)) for c in columns))))
    return out.withColumn("tokens_used", used).withColumnRenamed("__id", "record_id")


def sealed(column: Column, key: bytes) -> Column:
    """AES-256-GCM: nonce, ciphertext and tag in one value."""
    return F.aes_encrypt(column, F.lit(key), F.lit("GCM"))


def opened(column: Column, key: bytes) -> Column:
    return F.aes_decrypt(column, F.lit(key), F.lit("GCM")).cast("string")


def cache_stats(tokens: DataFrame) -> DataFrame:
    """One row (entries, next_number, bytes) about a dictionary with columns original, pattern_type, number and token."""
    size = F.octet_length("token") + F.octet_length("original") + F.octet_length("pattern_type") + 32
    return tokens.agg(F.count("*").alias("entries"), (F.max("number") + 1).alias("next_number"), F.sum(size).alias("bytes"))


def survivors(access: DataFrame, key: str, at: str, size: Column, now: Column, entries: int, budget: int, ttl_seconds: int) -> DataFrame:
    """Rows of a cache that stay: last used within the time to live, then the most recent ones up to a number and a budget.

    Each key's last use is aggregated first. Recency ranks are consecutive numbers from range partitions; the running size
    is added up over what the number bounds.
    """
    last = access.groupBy(key).agg(F.max(at).alias("last_used"), F.max(size).alias("bytes"))
    alive = last.where(F.unix_timestamp(now) - F.unix_timestamp("last_used") <= ttl_seconds)
    newest = alive.orderBy(F.desc("last_used"), key).limit(entries)
    running = F.sum("bytes").over(Window.orderBy(F.desc("last_used"), key).rowsBetween(Window.unboundedPreceding, 0))
    return newest.withColumn("running_bytes", running).where(F.col("running_bytes") <= budget)
