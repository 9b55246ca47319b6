"""Licence scan: Aho-Corasick over words for tags and notices, and a shunting-yard parser for licence expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, utf8

#: Phrases whose places are counted, with their labels.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Further notices, with their labels.
MORE_PHRASES = {
    "permission is hereby granted free of charge": "mit",
    "licensed under the apache license": "apache-2",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license version 2": "mpl-2",
    "redistribution and use in source and binary forms": "bsd",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "creative commons attribution": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0 1 0": "cc0",
    "public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
TAG = "spdx license identifier"
#: How much one kind of evidence leaves open; the score is one minus their product.
OPEN = {"base": 0.4, "more": 0.5, "tag": 0.1}
# Identifiers of the SPDX licence list that expressions may name beside those with the prefixes below.
IDENTIFIERS = frozenset(
    """
    0bsd afl-2.1 afl-3.0 agpl-1.0 agpl-3.0 agpl-3.0-only agpl-3.0-or-later apache-1.0 apache-1.1 apache-2.0 artistic-1.0
    artistic-2.0 blueoak-1.0.0 bsd-1-clause bsd-2-clause bsd-2-clause-patent bsd-3-clause bsd-3-clause-clear bsd-4-clause
    bsl-1.0 busl-1.1 cc-by-1.0 cc-by-2.0 cc-by-2.5 cc-by-3.0 cc-by-4.0 cc-by-nc-3.0 cc-by-nc-4.0 cc-by-nc-nd-3.0
    cc-by-nc-nd-4.0 cc-by-nc-sa-3.0 cc-by-nc-sa-4.0 cc-by-nd-3.0 cc-by-nd-4.0 cc-by-sa-2.0 cc-by-sa-3.0 cc-by-sa-4.0
    cc0-1.0 cddl-1.0 cddl-1.1 cecill-2.1 cpl-1.0 curl ecl-2.0 efl-2.0 epl-1.0 epl-2.0 eupl-1.1 eupl-1.2 ftl gfdl-1.2
    gfdl-1.3 gpl-1.0 gpl-1.0-only gpl-1.0-or-later gpl-2.0 gpl-2.0-only gpl-2.0-or-later gpl-3.0 gpl-3.0-only
    gpl-3.0-or-later hpnd icu ijg ipl-1.0 isc json lgpl-2.0 lgpl-2.0-only lgpl-2.0-or-later lgpl-2.1 lgpl-2.1-only
    lgpl-2.1-or-later lgpl-3.0 lgpl-3.0-only lgpl-3.0-or-later libpng libtiff lppl-1.3c miros mit mit-0 mpl-1.0 mpl-1.1
    mpl-2.0 ms-pl ms-rl mulanpsl-2.0 naist-2003 ncsa odbl-1.0 odc-by-1.0 ofl-1.0 ofl-1.1 openssl osl-3.0 pddl-1.0 php-3.01
    postgresql psf-2.0 python-2.0 qpl-1.0 rpl-1.5 ruby sissl sleepycat sspl-1.0 tcl unicode-3.0 unicode-dfs-2016 unlicense
    upl-1.0 vim w3c wtfpl x11 zlib zpl-2.1
    """.split()
)
#: Prefixes of identifiers that a document defines itself, and what the name of an exception behind ``with`` has.
OWN_PREFIXES, EXCEPTION = ("licenseref-", "documentref-"), "exception"
#: Identifiers whose licences ask for little; an expression is permissive if some choice of its licences is.
PERMISSIVE = {"mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "cc0-1.0", "unlicense", "zlib", "cc-by-4.0"}
BINDS = {"with": 3, "and": 2, "or": 1}

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_TAG_LINE = re.compile(rb"spdx-license-identifier:[ \t]*([^\r\n]*)", re.IGNORECASE)
_TOKEN = re.compile(r"[()/]|[A-Za-z0-9.+:-]+")


def words_of(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text: A-Z lower-cased, runs of digits, letters a-z and everything beyond ASCII."""
    return text.translate(_FOLD).split()


def is_known(identifier: str, after_with: bool = False, known: frozenset[str] = IDENTIFIERS) -> bool:
    """Whether an identifier (lower-case) may stand in an expression: a listed licence, with or without a plus behind it, one
    that a document defines itself, or, behind ``with``, an exception."""
    if after_with:
        return EXCEPTION in identifier or identifier.startswith(OWN_PREFIXES)
    return identifier.removesuffix("+") in known or identifier.startswith(OWN_PREFIXES)


def to_postfix(expression: str, known: frozenset[str] = IDENTIFIERS) -> list[str] | None:
    """The licence expression at a text's beginning in postfix order (shunting-yard; with binds before and, and before or).

    It ends where prose begins: at an operand or ``(`` behind an operand, a ``)`` that none opened, or an identifier that is
    not known. What counts is the longest beginning that ends with an operand or ``)``: an operator or ``(`` behind that is prose,
    too, and parentheses that are open there are closed. A slash reads as or; full stops and colons behind a name aren't
    its own. None if there is no expression.
    """
    out: list[str] = []
    stack: list[str] = []
    complete: list[str] | None = None
    wants_operand = True
    for token in _TOKEN.findall(expression):
        low = "or" if token == "/" else token.lower().rstrip(".:")
        if low in BINDS:
            if wants_operand:
                break
            while stack and BINDS.get(stack[-1], 0) >= BINDS[low]:
                out.append(stack.pop())
            stack.append(low)
            wants_operand = True
        elif token == "(":
            if not wants_operand or stack[-1:] == ["with"]:
                break
            stack.append("(")
        elif token == ")":
            if wants_operand or "(" not in stack:
                break
            while (top := stack.pop()) != "(":
                out.append(top)
        else:
            if not wants_operand or not is_known(low, stack[-1:] == ["with"], known):
                break
            out.append(low)
            wants_operand = False
        if not wants_operand:
            complete = out + [x for x in reversed(stack) if x != "("]
    return complete


def evaluate(postfix: list[str]) -> tuple[set[str], bool]:
    """The licences that an expression names, and whether it can be met with permissive ones alone."""
    stack: list[tuple[set[str], bool]] = []
    for token in postfix:
        if token not in BINDS:
            stack.append(({token}, token in PERMISSIVE))
            continue
        (right, free_right), (left, free_left) = stack.pop(), stack.pop()
        if token == "with":
            stack.append(({f"{x}-with-{y}" for x in left for y in right}, free_left))
        else:
            stack.append((left | right, free_left or free_right if token == "or" else free_left and free_right))
    return stack[0]


def automaton() -> ahocorasick.Automaton:
    """Every phrase and the tag between word ends; values are (kind, label, words)."""
    found = ahocorasick.Automaton()
    for kind, phrases in (("base", BASE_PHRASES), ("more", MORE_PHRASES), ("tag", {TAG: ""})):
        for phrase, label in phrases.items():
            found.add_word(f" {phrase} ", (kind, label, len(f" {phrase} ")))
    found.make_automaton()
    return found


def scan(text: bytes, machine: ahocorasick.Automaton) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, expressions, permissive) of one text."""
    words = words_of(text)
    line = b" ".join([b"", *words, b""]).decode("utf-8", "replace")
    hits = [(end - size + 1, kind, label) for end, (kind, label, size) in machine.iter(line)] if words else []
    if not hits:
        return len(words), 0, None, None, "", "", 0.0, [], None
    kinds = {kind for _, kind, _ in hits}
    base = {label for _, kind, label in hits if kind == "base"}
    labels = {label for _, kind, label in hits if label}
    expressions, free = [], []
    if "tag" in kinds:
        for match in _TAG_LINE.finditer(text):
            postfix = to_postfix(match[1].decode("utf-8", "replace"))
            if postfix:
                names, permissive = evaluate(postfix)
                labels |= names
                expressions.append(" ".join(postfix))
                free.append(permissive)
        if not expressions:
            kinds.discard("tag")
    starts = sorted(at for at, kind, _ in hits if kind == "base")
    first = last = None
    if starts:
        spaces = np.flatnonzero(np.frombuffer(line.encode("utf-32-le"), "<u4") == 32)
        first, last = (int(np.searchsorted(spaces, at)) for at in (starts[0], starts[-1]))
    score = round(1 - float(np.prod([OPEN[k] for k in sorted(kinds)])), 6)
    return len(words), len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score, expressions, all(free) if free else None


_COLUMNS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>, permissive boolean"


def scan_licences(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (id, n_words, n_base, first_word, last_word, base_labels, labels, score, expressions, permissive).

    ``labels`` holds those of all notices and the identifiers of the expressions behind identifier tags, as far as they are known;
    ``expressions`` are these in postfix order, ``permissive`` tells whether all of them can be met with permissive
    licences (null without one). Null texts count as empty: no words, no labels, score 0. Tags without a known licence are
    passed over. Repeated rows and equal ids each keep a row; other columns are ignored; an empty table gives an empty
    result.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.string()), pa.bool_()]
        for batch in batches:
            rows = [scan(x, machine) for x in batch.column(1).to_pylist()]
            columns = list(zip(*rows)) or [()] * len(kinds)
            arrays = [pa.array(list(c), kind) for c, kind in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["id", *(x.split()[0] for x in _COLUMNS.split(", "))])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("id"), utf8(text_column).alias("text")).mapInArrow(run, f"id {kind}, {_COLUMNS}")


def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences of every document."""
    return scan_licences(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
