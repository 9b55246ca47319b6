"""Secret scan: Boolean trigram queries derived from the rules' regexes, answered from an inverted index of every segment of
texts, and regexes run on the candidates alone."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from re import _constants as ops
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffers, small_batches, table, utf8


@dataclass(frozen=True)
class Rule:
    """A kind of secret: what matches ``regex``, leftmost and without overlaps, if its ``group`` has ``least`` characters."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0
    base: bool = False


BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", "AKIA[A-Z0-9]+", 0, 16, True),
    # Runs of at least 32; a shorter run matches nowhere, so that this is all runs without the short ones.
    Rule("hex", "[0-9a-f]{32,}", base=True),
)
#: Further kinds, behind the others in every order.
MORE_RULES = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("url", r"://[^\x00-\x20/:@]+:[^\x00-\x20/:@]+@"),
)
RULES = BASE_RULES + MORE_RULES

#: A query: None (every text may match), a trigram, or ("and" | "or", parts).
Query = None | bytes | tuple
#: So many strings a part of a regex may stand for, and characters a class may have, to be written out.
MOST_STRINGS, MOST_CHARACTERS = 64, 8

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def joined(how: str, parts: Iterable[Query]) -> Query:
    """The conjunction or disjunction of queries, without what is said twice or says nothing."""
    parts = set(parts)
    if how == "or" and None in parts:
        return None
    flat: set = set()
    for part in parts - {None}:
        flat.update(part[1]) if isinstance(part, tuple) and part[0] == how else flat.add(part)
    if how == "or":  # what holds all trigrams of another alternative adds nothing
        terms = {p: p[1] if isinstance(p, tuple) and p[0] == "and" else frozenset([p]) for p in flat}
        flat = {p for p in flat if not any(q != p and terms[q] < terms[p] for q in flat)}
    if not flat:
        return None
    return next(iter(flat)) if len(flat) == 1 else (how, frozenset(flat))


def of_strings(strings: Iterable[bytes]) -> Query:
    """What a text must hold if it holds one of these strings."""
    return joined("or", [joined("and", (s[i : i + 3] for i in range(len(s) - 2))) for s in strings])


def trigram_query(regex: str, flags: int = re.ASCII) -> Query:
    """The Boolean query over trigrams (of UTF-8 with A-Z lower-cased) that every text with a match of ``regex`` fulfils.

    None if the regex has no mandatory trigrams. Parts of the regex stand for sets of strings as long as these are few;
    where they are not, the trigrams so far are asked for and a new string begins.
    """
    strings, query = _sequence(_parser.parse(regex, flags), flags)
    return of_strings(strings) if strings is not None else query


def _sequence(items, flags: int) -> tuple[set[bytes] | None, Query]:
    """The strings that a sequence stands for (None: not known) and, if they aren't known, what it asks for."""
    run, asked, whole = {b""}, [], True
    for op, value in items:
        strings, query, more = _part(op, value, flags)
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = {a + b for a in run for b in strings}
        else:
            asked += [of_strings(run), query]
            run, whole = strings or {b""}, False
        if more:  # repeated further: what follows comes behind the last time
            asked.append(of_strings(run))
            run, whole = strings or {b""}, False
    return (run, None) if whole else (None, joined("and", [*asked, of_strings(run)]))


def _part(op, value, flags: int) -> tuple[set[bytes] | None, Query, bool]:
    """As :func:`_sequence` for one part, and whether that may be repeated more often than the strings tell."""
    if op is ops.LITERAL:
        return _characters([value], flags), None, False
    if op is ops.IN:
        found: list[int] = []
        for kind, x in value:
            if kind is ops.LITERAL:
                found.append(x)
            elif kind is ops.RANGE and x[1] - x[0] < MOST_CHARACTERS:
                found += range(x[0], x[1] + 1)
            else:
                return None, None, False
        return (_characters(found, flags) if len(found) <= MOST_CHARACTERS else None), None, False
    if op is ops.SUBPATTERN:
        _, on, off, inner = value
        return *_sequence(inner, (flags | on) & ~off), False
    if op is ops.ATOMIC_GROUP:
        return *_sequence(value, flags), False
    if op is ops.BRANCH:
        known = [_sequence(x, flags) for x in value[1]]
        if all(s is not None for s, _ in known) and sum(len(s) for s, _ in known) <= MOST_STRINGS:
            return set().union(*(s for s, _ in known)), None, False
        return None, joined("or", [of_strings(s) if s is not None else q for s, q in known]), False
    if op in (ops.MAX_REPEAT, ops.MIN_REPEAT, ops.POSSESSIVE_REPEAT):
        least, most, inner = value
        strings, query = _sequence(inner, flags)
        if least == 0:
            return ({b""} | strings if strings is not None and most == 1 else None), None, False
        if strings is None:
            return None, query, False
        times = 1
        once = strings
        while times < least and len(strings) * len(once) <= MOST_STRINGS:
            strings, times = {a + b for a in strings for b in once}, times + 1
        return strings, None, times < most
    if op in (ops.AT, ops.ASSERT, ops.ASSERT_NOT):  # stands for no characters, and what it asks for is left out
        return {b""}, None, False
    return None, None, False


def _characters(points: list[int], flags: int) -> set[bytes] | None:
    """Characters as folded UTF-8; None where other characters may count as equal to them."""
    if flags & re.IGNORECASE and not flags & re.ASCII:
        return None
    if flags & re.IGNORECASE and any(p > 127 for p in points):
        return None
    return {chr(p).encode("utf-8", "surrogatepass").translate(_FOLD) for p in points}


def terms_of(query: Query) -> set[bytes]:
    """The trigrams that a query asks for."""
    if query is None:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(terms_of, query[1]))


class Terms:
    """The trigrams to index: numbers by their 24 bits."""

    def __init__(self, wanted: Iterable[bytes]) -> None:
        self.names = sorted(wanted)
        self.number = np.zeros(1 << 24, np.uint16 if len(self.names) < 1 << 16 else np.uint32)
        for i, term in enumerate(self.names, 1):
            self.number[int.from_bytes(term, "big")] = i


def index_segment(folded: np.ndarray, offsets: np.ndarray, terms: Terms) -> dict[bytes, np.ndarray]:
    """The inverted index of a segment: of each trigram of ``terms`` the numbers of the texts with it, ascending."""
    if len(folded) < 3:
        return {}
    wide = folded.astype(np.uint32)
    number = terms.number[(wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]]
    at = np.flatnonzero(number)
    text = np.searchsorted(offsets, at, "right") - 1
    inside = at + 2 < offsets[text + 1]
    count = len(offsets) - 1
    pairs = np.unique(number[at[inside]].astype(np.int64) * count + text[inside])
    which, text = np.divmod(pairs, count)
    cuts = np.searchsorted(which, np.arange(1, len(terms.names) + 2))
    return {name: text[a:b] for name, a, b in zip(terms.names, cuts[:-1], cuts[1:]) if b > a}


def candidates(query: Query, index: dict[bytes, np.ndarray], count: int) -> np.ndarray:
    """The numbers of the texts of a segment that fulfil a query: postings intersected and united."""
    if query is None:
        return np.arange(count)
    if isinstance(query, bytes):
        return index.get(query, np.empty(0, np.int64))
    lists = [candidates(q, index, count) for q in query[1]]
    if query[0] == "or":
        return np.unique(np.concatenate(lists))
    lists.sort(key=len)
    out = lists[0]
    for other in lists[1:]:
        if not len(out):
            break
        out = np.intersect1d(out, other, assume_unique=True)
    return out


def spans_of(text: str, rule: Rule, regex: re.Pattern) -> list[tuple[int, int]]:
    """(start, end) in code points of what a rule finds in a text."""
    return [m.span() for m in regex.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def scan_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows (id, found): what each rule finds in each text, as an array of (kind, rule, start, end, base) in order of start,
    then of the rules; start and end count code points, the end is exclusive.

    An Arrow batch of texts is a segment with an inverted index of its own, so the index needs no shuffle and no memory
    beyond the batch. Each rule's regex becomes a Boolean query over trigrams; only texts in the intersected postings are
    searched with it, and all texts for rules without mandatory trigrams. Null texts count as empty; rows that repeat an id or a
    text each keep a row; other columns are ignored; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = [trigram_query(r.regex) for r in rules]
        compiled = [re.compile(r.regex, re.ASCII) for r in rules]
        terms = Terms(set().union(*map(terms_of, queries)))
        kind = pa.list_(pa.struct([("kind", pa.string()), ("rule", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
        for batch in batches:
            raw, offsets = buffers(batch.column(1))
            folded = np.frombuffer(raw.tobytes().translate(_FOLD), np.uint8)
            index = index_segment(folded, offsets, terms)
            found: list[list] = [[] for _ in range(batch.num_rows)]
            texts: dict[int, str] = {}
            for i, (rule, query) in enumerate(zip(rules, queries)):
                for k in candidates(query, index, batch.num_rows).tolist():
                    if k not in texts:
                        texts[k] = raw[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace")
                    found[k] += [(a, i, b) for a, b in spans_of(texts[k], rule, compiled[i])]
            rows = [[{"kind": rules[i].kind, "rule": i, "start": a, "end": b, "base": rules[i].base} for a, i, b in sorted(x)] for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["id", "found"])

    kind = docs.schema[id_column].dataType.simpleString()
    found = "array<struct<kind:string,rule:int,start:bigint,end:bigint,base:boolean>>"
    return docs.select(F.col(id_column).alias("id"), utf8(text_column).alias("text")).mapInArrow(run, f"id {kind}, found {found}")


def masked(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every secret in the text replaced by its kind in angle brackets; all columns and rows stay.

    Where secrets overlap, what they cover together is replaced by the first one's kind. Null texts stay null.
    """
    fields = docs.columns
    keyed = docs.select(F.struct(*fields).alias("__row"), text_column)
    found = scan_secrets(keyed.select("__row", F.col(text_column).alias("__text")), "__row", "__text", rules)
    step = """
      aggregate(__found, named_struct('out', '', 'at', 0L), (s, x) -> IF(x.start >= s.at,
        named_struct('out', concat(s.out, substr(__text, int(s.at) + 1, int(x.start - s.at)), '<', x.kind, '>'), 'at', x.end),
        named_struct('out', s.out, 'at', greatest(s.at, x.end))), s -> concat(s.out, substr(__text, int(s.at) + 1)))
    """
    rows = found.select(F.col("id").alias("__row"), F.col("found").alias("__found"), F.col("id")[text_column].alias("__text"))
    hidden = F.when(F.col("__text").isNotNull() & (F.size("__found") > 0), F.expr(step)).otherwise(F.col("__text"))
    return rows.select(*((hidden if f == text_column else F.col("__row")[f]).alias(f) for f in fields))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every document: how many of each base kind, a digest of their places, and all places."""
    found = scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    written_out = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = written_out(F.filter("found", lambda x: x["base"]))
    return found.select(F.col("id").alias("doc_id"), *map(count, ("assign", "access", "hex")), F.sha2(base, 256).alias("base_sha256"), written_out(F.col("found")).alias("spans"))


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _twin() -> str:
    """Places out of the pieces between matches: a match starts behind all pieces and matches before it."""
    names = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
    regexes = {
        "assign": rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        "access": "AKIA[A-Z0-9]+",
        "hex": "[0-9a-f]+",
    } | {r.kind: r.regex for r in MORE_RULES}
    parts = []
    for i, (kind, regex) in enumerate(regexes.items()):
        literal = "'" + regex.replace("'", "''") + "'"
        holds = {"assign": f"length(regexp_extract(hit, {literal}, 2)) >= 8", "access": "length(hit) >= 16", "hex": "length(hit) >= 32"}.get(kind, "true")
        parts.append(f"""
  SELECT doc_id, no, '{kind}' AS kind, {i} AS k, start, start + length(hit) AS stop FROM (
    SELECT doc_id, no, hits[i] AS hit, list_sum(list_transform(pieces[1:i], lambda x: length(x)))
             + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS start
    FROM (SELECT doc_id, no, hits, pieces, unnest(range(1, len(hits) + 1)) AS i
          FROM (SELECT doc_id, no, regexp_extract_all(text, {literal}) AS hits, string_split_regex(text, {literal}) AS pieces FROM docs)))
  WHERE {holds}""")
    union = "\n  UNION ALL".join(parts)
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS no FROM documents),
found AS ({union}
), told AS (
  SELECT no, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, k) FILTER (k < 3) AS base,
         string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, k) AS spans
  FROM found GROUP BY no
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN told USING (no)
"""


OP13_SQL = _twin()
