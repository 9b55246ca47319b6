"""Checks that go beyond a regex, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the e-mail grammar of the HTML standard.
EMAIL_GRAMMAR = (
    r"^[a-zA-Z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?"
    r"(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)*$"
)
# Fixed value: four groups of four digits.
CARD_REGEX = r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b"
MAX_EMAIL_BYTES, MAX_LOCAL, MAX_DOMAIN = 320, 64, 255
#: Longer texts (in bytes) go through the text engines untouched, and of one rule so many matches count.
MAX_TEXT_BYTES, MAX_MATCHES = 100_000, 1000


def is_email(word: Column) -> Column:
    """Whether a word is a valid address: the grammar, at most 64 bytes before the @ and 255 behind it."""
    local, domain = F.substring_index(word, "@", 1), F.substring_index(word, "@", -1)
    return word.rlike(EMAIL_GRAMMAR) & (F.octet_length(local) <= MAX_LOCAL) & (F.octet_length(domain) <= MAX_DOMAIN)


def emails(text: Column) -> Column:
    """The valid addresses among a text's words, in order; cheap checks on the word come first."""

    def worth(word: Column) -> Column:
        size = F.octet_length(word)
        return (size > 5) & (size <= MAX_EMAIL_BYTES) & word.contains("@") & word.contains(".")

    words = F.filter(F.split(text, r"\s+"), worth)
    bare = F.transform(words, lambda w: F.regexp_replace(w, r"[.,;:!?]+$", ""))
    return F.filter(bare, is_email)


def cards(text: Column) -> Column:
    """The card numbers of a text whose digits pass the Luhn check, as written."""
    found = F.regexp_extract_all(text, F.lit(CARD_REGEX), F.lit(0))
    return F.filter(found, lambda m: F.call_function("luhn_check", F.regexp_replace(m, "[^0-9]", "")))


def masked(sample: Column) -> Column:
    """A sample fit to be shown: the first and last two characters; short ones are hidden altogether."""
    short = F.repeat(F.lit("*"), F.length(sample))
    return F.when(F.length(sample) <= 4, short).otherwise(F.concat(F.left(sample, F.lit(2)), F.lit("***"), F.right(sample, F.lit(2))))


def guarded(text: Column, changed: Column, most_bytes: int = MAX_TEXT_BYTES) -> Column:
    """``changed``, or the text itself if it is too long for the text engines."""
    return F.when(F.octet_length(text) > most_bytes, text).otherwise(changed)
