"""Licence scans against plain search, and the expression parser."""

import ast
import itertools
import re

import pytest

from sablefin.llm import licences

BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def plain(text):
    words = WORD.findall(text.translate(LOWER))
    found = [(i, label) for phrase, label in BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    places = [i for i, _ in found]
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in found}))


@pytest.mark.parametrize(
    "expression, postfix",
    [
        ("MIT", ["mit"]),
        ("MIT OR Apache-2.0 AND BSD-3-Clause", ["mit", "apache-2.0", "bsd-3-clause", "and", "or"]),
        ("(MIT OR Apache-2.0) AND BSD-3-Clause", ["mit", "apache-2.0", "or", "bsd-3-clause", "and"]),
        ("GPL-2.0-only WITH Classpath-exception-2.0 AND MIT", ["gpl-2.0-only", "classpath-exception-2.0", "with", "mit", "and"]),
        ("((MIT))", ["mit"]),
        ("MIT */", ["mit"]),
        ("MIT and more words", ["mit"]),
        ("MIT (see LICENSE)", ["mit"]),
        ("MIT)", ["mit"]),
        ("MIT) or so", ["mit"]),
        ("hello world foo", None),
        ("LicenseRef-Own OR MPL-2.0+", ["licenseref-own", "mpl-2.0+", "or"]),
        ("MIT WITH prose", ["mit"]),
        ("(MIT AND (ISC OR Zlib)) text", ["mit", "isc", "zlib", "or", "and"]),
        ("", None),
        ("OR MIT", None),
        ("MIT OR", ["mit"]),
        ("(MIT", ["mit"]),
        ("(MIT OR foo", ["mit"]),
        ("MIT AND (see LICENSE)", ["mit"]),
        ("MIT OR (at your option) Apache-2.0", ["mit"]),
        ("(MIT AND BSD-3-Clause) OR (Apache-2.0", ["mit", "bsd-3-clause", "and", "apache-2.0", "or"]),
        ("Apache-2.0 OR MIT.", ["apache-2.0", "mit", "or"]),
        ("MIT/Apache-2.0", ["mit", "apache-2.0", "or"]),
        ("MIT / Apache-2.0 AND ISC: more", ["mit", "apache-2.0", "isc", "and", "or"]),
        ("/MIT", None),
        ("()", None),
    ],
)
def test_shunting_yard(expression, postfix):
    assert licences.to_postfix(expression) == postfix


def test_evaluation():
    of = lambda x: licences.evaluate(licences.to_postfix(x))
    assert of("MIT AND GPL-3.0-only") == ({"mit", "gpl-3.0-only"}, False)
    assert of("MIT OR GPL-3.0-only") == ({"mit", "gpl-3.0-only"}, True)
    assert of("GPL-2.0-only WITH Classpath-exception-2.0") == ({"gpl-2.0-only-with-classpath-exception-2.0"}, False)


TEXTS = [
    "", " ", "Released UNDER the MIT-License.", "cc by nc cc by nc", "cc-by-nc/cc,by;nc", "under the mit licenses", "xcc by nc", "cc by ncé",
    "ÀPACHE apache license version 2 İ", "a" * 10_000 + " cc by nc", "under the mit license " * 500, "K apache license, version 2.0",
]


def test_scan_equals_plain_search(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*TEXTS, None])], "doc_id long, text string, labels string")
    for r in licences.scan_licences(df).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain(([*TEXTS, None])[r.id] or "")
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert licences.scan_licences(df.limit(0)).count() == 0


def test_tags_and_expressions(spark):
    text = "// SPDX-License-Identifier: (MIT OR GPL-2.0-only)\nx\n# spdx-license-identifier: AND\n"
    row = licences.scan_licences(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.labels == "gpl-2.0-only,mit" and row.expressions == ["mit gpl-2.0-only or"] and row.permissive is True and row.n_base == 0


def test_forms_of_a_tag(spark):
    forms = ["(SPDX-License-Identifier: MIT)", "SPDX-License-Identifier: MIT (see LICENSE)", "SPDX-License-Identifier: hello world foo"]
    rows = licences.scan_licences(spark.createDataFrame(list(enumerate(forms)), "doc_id long, text string")).orderBy("id").collect()
    assert [(r.labels, r.score) for r in rows] == [("mit", 0.9), ("mit", 0.9), ("", 0.0)]


def test_long_texts_and_repeated_ids(spark):
    long = "word " * 300_000 + "cc by nc " + "SPDX-License-Identifier: " * 1000
    rows = licences.scan_licences(spark.createDataFrame([(1, long), (1, "cc by nc"), (1, "cc by nc")], "doc_id long, text string")).collect()
    assert sorted((r.n_words, r.n_base, r.first_word) for r in rows) == [(3, 1, 0), (3, 1, 0), (303_003, 1, 300_000)]


def test_query_equals_plain_search(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = licences.op4_licence_scan(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain(texts[r.doc_id])


def longest(expression):
    """(names, permissive) of the longest beginning that Python can parse as a boolean expression of known names."""
    tokens = [t if t in "()" else "or" if t == "/" else t.lower().rstrip(".:") for t in re.findall(r"[()/]|[A-Za-z0-9.+:-]+", expression)]
    for end in range(len(tokens), 0, -1):
        part, names, code, i = tokens[:end], {}, [], 0
        while i < end:
            name = part[i]
            if name in ("and", "or", "(", ")"):
                code.append(name)
            elif name == "with" or not licences.is_known(name):
                break
            else:
                whole = name
                if part[i + 1 : i + 2] == ["with"] and i + 2 < end and licences.is_known(part[i + 2], True):
                    whole, i = f"{name}-with-{part[i + 2]}", i + 2
                code.append(f"x{len(names)}_")
                names[code[-1]] = (whole, name in licences.PERMISSIVE)
            i += 1
        if i < end or part[-1] in ("and", "or", "("):
            continue
        try:
            tree = ast.parse(" ".join(code) + ")" * (code.count("(") - code.count(")")), mode="eval")
        except SyntaxError:
            continue
        if any(isinstance(n, ast.Call | ast.Tuple) for n in ast.walk(tree)):
            continue
        free = eval(compile(tree, "", "eval"), {}, {x: f for x, (_, f) in names.items()})  # noqa: S307
        return {n for n, _ in names.values()}, free
    return None


def test_expressions_against_another_parser():
    pieces = ["MIT", "Apache-2.0.", "GPL-2.0-only", "AND", "or", "WITH", "Classpath-exception-2.0", "(", ")", "/", "prose"]
    for size in range(1, 5):
        for tokens in itertools.product(pieces, repeat=size):
            text = " ".join(tokens)
            postfix = licences.to_postfix(text)
            assert (licences.evaluate(postfix) if postfix else None) == longest(text), text


def plain_labels(text):
    """(labels, score, number of expressions) by words and lines."""
    words = WORD.findall(text.translate(LOWER))
    line = " " + " ".join(words) + " "
    has = lambda phrases: {label for phrase, label in phrases.items() if f" {phrase} " in line}
    base, more = has(BASE), has(licences.MORE_PHRASES)
    tagged = []
    if f" {licences.TAG} " in line:
        tagged = [x for m in re.finditer("(?i)spdx-license-identifier:[ \t]*([^\r\n]*)", text, re.ASCII) if (x := longest(m[1]))]
    left = (0.4 if base else 1) * (0.5 if more else 1) * (0.1 if tagged else 1)
    return ",".join(sorted(base | more | set().union(*(n for n, _ in tagged)))), round(1 - left, 6), len(tagged), all(f for _, f in tagged) if tagged else None


def test_labels_equal_plain_search(spark, sf_dir):
    """On the table and on texts with tags, notices and prose in every order."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    bits = ["SPDX-License-Identifier: MIT/Apache-2.0\n", "spdx-license-identifier: (GPL-2.0-only OR foo\n", "SPDX-License-Identifier: nothing\n", "All rights reserved. ", "cc by sa ", "under the MIT license, ", "x "]
    docs += [(-1 - i, "".join(x)) for i, x in enumerate(itertools.permutations(bits, 3))]
    rows = licences.scan_licences(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    texts = dict(docs)
    for r in rows:
        assert (r.labels, r.score, len(r.expressions), r.permissive) == plain_labels(texts[r.id] or ""), texts[r.id][:300]
