"""Invariants of detection and tokenisation."""

import json
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sablefin.functions import validators
from sablefin.functions.patterns import Pattern, PatternSet, default_pii, hipaa, load_patterns, save_patterns, unicode_regex
from sablefin.operators import detect, tokenise

EMAIL = st.from_regex(r"\A[a-z]{2,8}@[a-z]{2,8}\.(com|org)\Z")
SSN = st.from_regex(r"\A[1-9]\d{2}-\d{2}-\d{4}\Z")
PLAIN = st.text("abc xyz.,é\n", max_size=15)
TEXT = st.lists(st.one_of(EMAIL, SSN, PLAIN), max_size=6).map(" ".join)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(TEXT, min_size=1, max_size=12))
def test_round_trips(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    tokens = tokenise.dictionary(df, "id", "text", default_pii())
    tokens = tokens.withColumn("token", tokenise.counter_token(F.col("pattern_type"), F.col("number")))
    done = tokenise.tokenise(df, "id", "text", tokens, default_pii())
    rows = {r.id: r for r in done.collect()}
    dictionary = {r.original: r.token for r in tokens.collect()}
    assert len(set(dictionary.values())) == len(dictionary)
    for i, text in enumerate(texts):
        assert not any(original in rows[i].text for original in dictionary)
        assert set(rows[i].tokens_used) == {t for t in dictionary.values() if t in rows[i].text}
        if not any(original in text for original in dictionary):
            assert rows[i].text == text
    back = {r.id: r.text for r in tokenise.detokenise(done, "id", "text", tokens).collect()}
    assert back == dict(enumerate(texts))
    text_done = df.select("id", tokenise.tokenise_text(F.col("text")).alias("text"))
    restored = tokenise.detokenise(text_done, "id", "text", tokenise.text_tokens(df, "text"))
    assert {r.id: r.text for r in restored.collect()} == dict(enumerate(texts))


MARKS = st.text("\ue000\ue001\ue003\uf8ff\uf700\uf7ffa-1 ", max_size=12)
LIKE_TOKENS = st.from_regex(r"\A\[?(EMAIL|LITERAL|SSN)[-_]0{0,7}[0-9A-F]\]?\Z")
HARD = st.one_of(st.none(), st.lists(st.one_of(EMAIL, LIKE_TOKENS), max_size=6).map(" ".join), st.lists(st.one_of(EMAIL, SSN, PLAIN, MARKS), max_size=6).map(" ".join), st.lists(st.one_of(SSN, MARKS), max_size=4).map("".join))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(HARD, min_size=1, max_size=14))
def test_round_trips_of_hard_texts(spark, texts):
    """Characters that serve as marks, null texts, null and repeated keys, and a text of 200 KB."""
    texts = [*texts, "call 123-45-6789 now", "xy 123-45-6789 end \ue000\uf8ff", "word " * 40_000 + "a@b.com 123-45-6789"]
    rows = [(None if i % 3 == 0 else i % 5, i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, n long, text string")
    tokens = tokenise.dictionary(df, "id", "text", default_pii())
    tokens = tokens.withColumn("token", tokenise.counter_token(F.col("pattern_type"), F.col("number")))
    done = tokenise.tokenise(df, "id", "text", tokens, default_pii())
    hidden = {r.n: r.text for r in done.collect()}
    originals = [r.original for r in tokens.collect()]
    assert len(hidden) == len(texts) and "123-45-6789" in originals
    assert not any(o in (t or "") for t in hidden.values() for o in originals)
    back = {r.n: r.text for r in tokenise.detokenise(done, "id", "text", tokens).collect()}
    assert back == dict(enumerate(texts))
    exact = df.select("n", tokenise.tokenise_text(F.col("text"), most_bytes=None, most_matches=None).alias("text"))
    known = tokenise.text_tokens(df, "text", most_bytes=None, most_matches=None)
    assert {r.n: r.text for r in tokenise.detokenise(exact, "n", "text", known).collect()} == dict(enumerate(texts))
    assert "123-45-6789" not in exact.where(f"n = {len(texts) - 1}").first().text


def test_a_match_without_a_token_is_an_error(spark):
    df = spark.createDataFrame([(1, "call 123-45-6789 now")], "id long, text string")
    none = spark.createDataFrame([], "original string, token string")
    with pytest.raises(Exception, match="no token"):
        tokenise.tokenise(df, "id", "text", none, default_pii()).collect()


def test_more_matches_than_the_guard(spark):
    text = " ".join(f"{i % 900 + 100:03d}-{i % 90 + 10:02d}-{i % 9000 + 1000:04d}" for i in range(1500))
    df = spark.createDataFrame([(text,)], "text string")
    guarded, exact, secure = df.select(
        tokenise.tokenise_text(F.col("text")), tokenise.tokenise_text(F.col("text"), most_bytes=None, most_matches=None), tokenise.tokenise_secure(F.col("text"), most_bytes=None, most_matches=None)
    ).first()
    rest = re.compile(r"\b\d{3}-\d{2}-\d{4}\b")
    assert len(rest.findall(guarded)) == 500 and not rest.findall(exact) and not rest.findall(secure)


def test_records_and_kept_dictionaries(spark):
    df = spark.createDataFrame([(1, "a@b.com", "c@d.org 123-45-6789"), (2, None, "a@b.com"), (2, "x", "c@d.org")], "id long, mail string, note string")
    tokens = tokenise.record_dictionary(df, "id", ["mail", "note"], default_pii())
    assert [(r.original, r.number) for r in tokens.orderBy("number").collect()] == [("a@b.com", 0), ("123-45-6789", 1), ("c@d.org", 2)]
    known = spark.createDataFrame([("c@d.org", "EMAIL", 7), ("old", "EMAIL", 9)], "original string, pattern_type string, number long")
    merged = tokenise.merged_dictionary(known, tokens)
    assert {(r.original, r.number) for r in merged.collect()} == {("c@d.org", 7), ("old", 9), ("a@b.com", 10), ("123-45-6789", 11)}
    merged = merged.withColumn("token", tokenise.counter_token(F.col("pattern_type"), F.col("number")))
    done = tokenise.tokenise_columns(df, "id", ["mail", "note"], merged, default_pii())
    assert sorted((r.mail, r.note, tuple(r.tokens_used)) for r in done.where("id = 1").collect()) == [("[EMAIL-10]", "[EMAIL-7] [SSN-11]", ("[EMAIL-10]", "[SSN-11]", "[EMAIL-7]"))]
    assert done.count() == 3


def test_priority_and_reuse(spark):
    df = spark.createDataFrame([(1, "4111111111111111 and 123-45-6789"), (2, "123-45-6789 again")], "id long, text string")
    tokens = tokenise.dictionary(df, "id", "text", default_pii()).collect()
    assert {(r.original, r.pattern_type, r.number) for r in tokens} == {("123-45-6789", "SSN", 0), ("4111111111111111", "CREDIT_CARD", 1)}


def test_numbers_are_consecutive_over_partitions(spark):
    df = spark.range(5000).withColumn("x", F.xxhash64("id"))
    found = tokenise.numbered(df, ["x"], "n").orderBy("x").collect()
    assert [r.n for r in found] == list(range(5000))


def test_nested_records(spark):
    schema = T.StructType(
        [
            T.StructField("user", T.StructType([T.StructField("mail", T.StringType()), T.StructField("age", T.LongType())])),
            T.StructField("more", T.ArrayType(T.StructType([T.StructField("mail", T.StringType())]))),
            T.StructField("map", T.MapType(T.StringType(), T.StringType())),
        ]
    )
    value = {"user": {"mail": "a@b.com", "age": 3}, "more": [{"mail": "c@d.org"}, {"mail": None}], "map": {"a@b.com": "a@b.com"}}
    df = spark.createDataFrame([(value,), (None,)], T.StructType([T.StructField("v", schema)]))
    done = df.select(tokenise.tokenise_nested(F.col("v"), schema).alias("v"))
    first, second = (r.v for r in done.collect())
    assert second is None and done.schema["v"].dataType.simpleString() == schema.simpleString()
    assert first.user.age == 3 and first.more[1].mail is None and list(first.map) == ["a@b.com"]
    assert first.user.mail == first.map["a@b.com"] != first.more[0].mail and first.user.mail.startswith("[EMAIL-")


def test_secure_engine_validates(spark):
    rows = ["mail a@b.com, now", "bad @b.com a@ x", "4532015112830366 and 1234 5678 9012 3456", "ssn 123-45-6789", "x" * 100_001 + " a@b.com"]
    df = spark.createDataFrame([(r,) for r in rows], "text string")
    found = [r[0] for r in df.select(tokenise.tokenise_secure(F.col("text"))).collect()]
    assert re.fullmatch(r"mail \[EMAIL-\d+\], now", found[0]) and found[1] == rows[1] and found[4] == rows[4]
    assert re.fullmatch(r"\[CREDIT_CARD-\d+\] and 1234 5678 9012 3456", found[2]) and re.fullmatch(r"ssn \[SSN-\d+\]", found[3])


def test_email_validity(spark):
    good = ["user@example.com", "a.b+c@sub.example.org", "x" * 64 + "@example.com"]
    bad = ["not-an-email@", "@example.com", "a@b@c.com", "x" * 65 + "@example.com", "a@-b.com", "plain", "a@" + "b" * 64 + ".com"]
    df = spark.createDataFrame([(x,) for x in good + bad], "w string")
    assert [r[0] for r in df.where(validators.is_email(F.col("w"))).collect()] == good


def test_masking(spark):
    df = spark.createDataFrame([("",), ("abcd",), ("abcde",), (None,)], "s string")
    assert [r[0] for r in df.select(validators.masked(F.col("s"))).collect()] == ["", "****", "ab***de", None]


def test_detection_without_rows(spark):
    empty = spark.createDataFrame([], "id long, text string")
    rows = detect.detect_source(empty, "id").collect()
    assert len(rows) == 10 and all(r.matches == 0 and r.confidence == 0 for r in rows)
    assert detect.recommend(detect.detect_source(empty, "id")).count() == 0


def test_source_and_columns(spark):
    rows = [(1, "user1@example.com", "Contact user2@example.com"), (2, "user3@example.com", None)]
    df = spark.createDataFrame(rows, "id long, email string, text string")
    found = {r.pattern_type: r for r in detect.detect_source(df, "id").collect()}
    assert found["EMAIL"].matches == 3 and found["EMAIL"].confidence == 1.5
    columns = {(r.column_name, r.pattern_type): r.matches for r in detect.detect_columns(df, ["email", "text"]).collect()}
    assert columns == {("email", "EMAIL"): 2, ("text", "EMAIL"): 1}


def test_pattern_sets(tmp_path):
    rules = PatternSet([Pattern("A", "a"), Pattern("B", "b").with_priority(200), Pattern("A", "c", enabled=False).with_description("x")])
    assert [p.regex for p in rules.by_priority()] == ["b", "a", "c"]
    assert [p.regex for p in rules.active()] == ["a", "b"]
    assert [p.regex for p in rules.one_per_type()] == ["c", "b"]
    assert [p.pattern_type for p in rules.without_type("A")] == ["B"]
    assert PatternSet() == [] and len(hipaa()) == 6
    save_patterns(rules, str(tmp_path / "rules.json"))
    assert load_patterns(str(tmp_path / "rules.json")) == rules


def test_unicode_option(spark):
    df = spark.createDataFrame([("٣٣٣-٣٣-٣٣٣٣",)], "s string")
    regex = default_pii()[1].regex
    plain, wide = df.select(F.regexp_count("s", F.lit(regex)), F.regexp_count("s", F.lit(unicode_regex(regex)))).first()
    assert (plain, wide) == (0, 1)


def test_sealing(spark):
    key = bytes(range(32))
    df = spark.createDataFrame([("a",), ("",), (None,)], "s string").withColumn("x", tokenise.sealed(F.col("s"), key))
    assert [(r.n, r.s == r.o) for r in df.select("s", F.octet_length("x").alias("n"), tokenise.opened(F.col("x"), key).alias("o")).collect()] == [(29, True), (28, True), (None, True)]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.lists(st.one_of(EMAIL, SSN, LIKE_TOKENS, PLAIN), max_size=6).map(" ".join), min_size=3, max_size=14))
def test_texts_that_hold_tokens_come_back(spark, texts):
    """By both engines; a rule without a prefix for its tokens makes any eight hexadecimal digits look like one."""
    texts = [*texts, "I type [EMAIL-0] and [LITERAL-0]", "a@b.com EMAIL_00000000 LITERAL_00000001 00000002", "x 00000000 badge-1"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    patterns = PatternSet([*default_pii(), Pattern("BADGE", r"badge-\d")])
    numbers = tokenise.dictionary(df, "id", "text", patterns)
    for token, regex in ((tokenise.counter_token, tokenise.TOKEN_REGEX), (tokenise.bounded_token, tokenise.BOUNDED_REGEX)):
        tokens = numbers.withColumn("token", token(F.col("pattern_type"), F.col("number")))
        done = tokenise.tokenise(df, "id", "text", tokens, patterns)
        assert {r.id: r.text for r in tokenise.detokenise(done, "id", "text", tokens, regex).collect()} == dict(enumerate(texts))


def _walked(value, change):
    if isinstance(value, str):
        return change(value)
    if isinstance(value, dict):
        return {k: _walked(v, change) for k, v in value.items()}
    return [_walked(v, change) for v in value] if isinstance(value, list) else value


LEAF = st.one_of(st.none(), st.booleans(), st.integers(-(10**9), 10**9), st.floats(-1e6, 1e6), EMAIL, st.text('a"\\\n\t@é\U0001f600{[:,', max_size=8), SSN.map(lambda s: f'"{s}":'))
JSON = st.recursive(LEAF, lambda inner: st.one_of(st.lists(inner, max_size=4), st.dictionaries(st.one_of(EMAIL, st.text('ab":\\', max_size=4)), inner, max_size=4)), max_leaves=12)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.tuples(JSON, st.booleans(), st.sampled_from([None, 1])), min_size=4, max_size=20))
def test_json_of_any_shape(spark, values):
    """Against a walk over the parsed value; what isn't a string is compared as it is written."""
    texts = [json.dumps(v, ensure_ascii=a, indent=i) for v, a, i in values]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    leaves = {x for row in df.select(tokenise.json_leaves(F.col("text")).alias("x")).collect() for x in row.x}
    changed = {x: y for x, y in df.sparkSession.createDataFrame([(x,) for x in leaves], "x string").select("x", tokenise.tokenise_text(F.col("x")).alias("y")).collect()}
    found = df.select("id", tokenise.tokenise_json(F.col("text")).alias("text"), F.to_json(tokenise.tokenise_variant(F.try_parse_json("text"))).alias("variant")).collect()
    for i, text, variant in found:
        want = _walked(values[i][0], changed.__getitem__)
        assert json.loads(text) == want
        if want == values[i][0]:
            assert text == texts[i]
        if variant is not None:
            assert json.loads(variant) == pytest.approx(want) if isinstance(want, float) else True
            assert [x for x in _strings(json.loads(variant))] == sorted_strings(want, json.loads(variant))


def _strings(value):
    if isinstance(value, str):
        yield value
    for inner in value.values() if isinstance(value, dict) else value if isinstance(value, list) else ():
        yield from _strings(inner)


def sorted_strings(want, got):
    """The strings of ``want`` in the order in which ``got``, whose names a VARIANT has sorted, holds them."""
    if isinstance(want, str):
        return [want]
    if isinstance(want, dict):
        return [x for k in got for x in sorted_strings(want[k], got[k])]
    return [x for w, g in zip(want, got) for x in sorted_strings(w, g)] if isinstance(want, list) else []


def test_json_edges(spark):
    long = '"' + "a\\n" * 60_000 + ' a@b.com"'
    texts = [None, "", "  ", "no json a@b.com", '{"a@b.com":"x"', '{"a":1,"a":"a@b.com"}', '{"n":12345678901234567890.10,"e":1E5 ,"s":"a\\u0040b.com"}', long, "[" * 60 + '"a@b.com"' + "]" * 60]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    rows = [r.t for r in df.select("id", tokenise.tokenise_json(F.col("text"), most_bytes=None).alias("t")).orderBy("id").collect()]
    assert rows[:3] == texts[:3] and "@" not in rows[3] + rows[4]
    assert rows[5].startswith('{"a":1,"a":"[EMAIL-') and rows[6].startswith('{"n":12345678901234567890.10,"e":1E5 ,"s":"[EMAIL-')
    assert "@" not in rows[7] and rows[7].startswith(long[:1000]) and rows[8].startswith("[" * 60 + '"[EMAIL-')


def test_guards_can_be_switched_off_everywhere(spark):
    text = "word " * 30_000 + "a@b.com"
    df = spark.createDataFrame([(1, text, (text,))], "id long, text string, record struct<x:string>")
    kind = df.schema["record"].dataType
    on = df.select(tokenise.tokenise_nested(F.col("record"), kind).alias("r"), tokenise.tokenise_json(F.to_json("record")).alias("j"))
    off = df.select(tokenise.tokenise_nested(F.col("record"), kind, most_bytes=None).alias("r"), tokenise.tokenise_json(F.to_json("record"), most_bytes=None).alias("j"))
    assert "@" in on.first().r.x and "@" in on.first().j
    assert "@" not in off.first().r.x and "@" not in off.first().j
    assert "@" in tokenise.tokenise_records(df, ["text"]).first().text and "@" not in tokenise.tokenise_records(df, ["text"], most_bytes=None).first().text


def test_columns_share_one_dictionary_join_and_rows_are_spread(spark, sf_dir):
    """However many columns: one join with the dictionary and one back; a regex stands in the plan once for each use of the marks."""
    from sablefin.plans import tokenisation

    df = tokenisation._contacts(spark, sf_dir)
    assert df.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism  # a small file is not one task's
    tokens = spark.createDataFrame([("a@b.com", "[EMAIL-0]")], "original string, token string")
    four = tokenise.tokenise_columns(df, "id", ["email", "ssn", "phone", "note"], tokens, default_pii())
    plan = four._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Join " in line for line in plan.splitlines()) == 2
