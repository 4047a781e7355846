"""Patterns that may take for ever are told from those that don't."""

import itertools
import re

import pytest

from interlinea.operators.features import DEFAULTS, METADATA, QUOTED, TERMINATOR
from interlinea.plans import registry, synthetic
from interlinea.sources import params, patterns
from interlinea.sources.patterns import may_not_end

ENDLESS = [
    "(a+)+$", "(a*)*$", "(a|a)*$", "(a|ab|b)*c$", "(a?b?)*$", r"([a-z]+)*\d", r"(\w+\s?)*$", "(?:x+x+)+y", r"([0-9]{1,3}\.?)+$", "(a{1,30}){2,20}$", "(.*)*x", "((ab)|(a)(b))+$",
    "(?i)(a|A)+$", "(?=(a+)+$)b", "(a|b|[ab])*c", "x|(a+)+$", r"(\x{61}|a)+$", "((a|b)(a|b)?)+$",
]
UNREAD = [r"\y", "(", "[a[bc]]", "[a-z&&[^b]]", "x{401}{401}", "(abcdefghij){8}" * 6]
PLAIN = [
    None, "", r"^\([0-9]+\)", "(a|b)*c", "a*a*a*$", "[0-9]+", "(ab|a)*c", " of the ", r"(\d{4})+$", r"^[0-9]+\.[0-9]", r"(\([0-9]+\)\s*)+$", "([a-z]+,)*$", r"[?!.][\"')]?\s*$",
    r"\p{Lu}+$", r"(?<n>a)b\k<n>", r"\Q(a+)+\E", "(abc)+(abc)*$", r"\x{A0}+", "(a?)*b", "(?:a|b|c)+", "(a{2,5}b)+", r"[\[(|]+\|", "(ab?)*$",
]


@pytest.mark.parametrize("pattern", ENDLESS + UNREAD)
def test_refused(pattern):
    assert may_not_end(pattern)


@pytest.mark.parametrize("pattern", PLAIN + [METADATA, QUOTED, TERMINATOR, *DEFAULTS.values(), *synthetic.PARAMS.values()])
def test_accepted(pattern):
    assert not may_not_end(pattern)


def test_two_words_by_their_products():
    """Two words can be cut in two ways just if they commute."""
    words = ["".join(w) for n in (1, 2, 3, 4) for w in itertools.product("ab", repeat=n)]
    for u, v in itertools.product(words, repeat=2):
        assert may_not_end(f"(?:{u}|{v})+$") == (u + v == v + u)


def test_sets_of_words_by_their_texts():
    """Of three words: some text of at most nine letters is cut in two ways, or none is (short words show it early)."""
    words = ["".join(w) for n in (1, 2, 3) for w in itertools.product("ab", repeat=n)]
    for code in itertools.islice(itertools.combinations(words, 3), 0, None, 7):
        seen, twice, texts = set(), False, [""]
        while texts and not twice:
            texts = [t + w for t in texts for w in code if len(t + w) <= 9]
            twice = len(texts) > len(set(texts)) or bool(seen & set(texts))
            seen |= set(texts)
        assert may_not_end(f"(?:{'|'.join(code)})+$") == twice, code


def test_a_documents_pattern_is_refused(spark):
    rows = [("bad", "ex_number_regex", "(a+)+$"), ("bad", "ex_head_number_regex", "[0-9]+"), ("good", "ex_number_regex", r"^\([0-9]+\)"), ("none", "ex_sub_number_regex", "("), ("empty", "expect_unparsed_vernacular_lines", "TRUE")]
    wide, errors = params.checked_params(params.params_wide(spark.createDataFrame(rows, "doc_id string, param string, value string")))
    assert {tuple(r) for r in errors.collect()} == {("bad", "params", "may not end: ex_number_regex"), ("none", "params", "not a pattern: ex_sub_number_regex")}
    got = {r.doc_id: (r.ex_number_regex, r.ex_head_number_regex, r.ex_sub_number_regex) for r in wide.collect()}
    assert got == {"bad": ("", "[0-9]+", ""), "good": (r"^\([0-9]+\)", "", ""), "none": ("", "", ""), "empty": ("", "", "")}
    assert re.match(got["good"][0], "(1) x")


def test_letters_are_renamed_in_order():
    """Patterns that differ in their letters only are tested once; where letters aren't all that a pattern has, it stays as it is."""
    assert patterns._renamed("(?:house|mouse)+$") == patterns._renamed("(?:water|later)+$") == "(?:abcde|fbcde)+$"
    assert all(patterns._renamed(p) == p for p in ("(?i)(z|Z)+$", r"(\\w|z)*", "[z]+", "z{2,}", "(?=z)y", "(?<z>y)", "zé", "z.y"))
    patterns._may_not_end.cache_clear()
    assert [may_not_end(f"(?:{w[:2]}|{w[2:]})+$") for w in ("abab", "toto", "nono", "abcd", "wxyz", "some")] == [True] * 3 + [False] * 3
    assert patterns._may_not_end.cache_info().misses == 2


def test_patterns_are_dealt_out_by_the_stated_number(spark):
    d = registry.QUERIES["pattern_checks"](spark, "/root/testdata/sf0.001")
    assert d.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
