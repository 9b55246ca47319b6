"""The cheap regexes let through whatever the library's own regexes match."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sablefin.functions.patterns import LIBRARY, NECESSARY, TEXT_RULES

REGEXES = sorted({r for regexes in LIBRARY.values() for r in regexes} | {r for _, r in TEXT_RULES})


@pytest.mark.parametrize("regex", REGEXES)
def test_what_a_regex_matches_has_what_is_necessary(regex):
    @settings(max_examples=30, deadline=None)
    @given(st.from_regex(re.compile(regex.replace(r"\b", ""), re.ASCII), fullmatch=True))
    def check(text):
        found = re.search(regex, f" {text} ", re.ASCII)
        assert not found or re.search(NECESSARY[regex], found[0], re.ASCII)

    check()


def test_every_regex_has_one():
    assert set(NECESSARY) == set(REGEXES)
