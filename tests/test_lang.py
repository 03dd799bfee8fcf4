"""Lexer and parser."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.lang.lexer import SyntaxProblem, lex
from larkspur.lang.parser import MISSING, parse


def value(source):
    (node,) = parse(source)
    assert node[0] == "value"
    return node[1]


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("1b", True), ("0110b", [False, True, True, False]), ("0x01ff03", [1, 255, 3]), ("0n", None), ("0w", float("inf")), ("-0w", float("-inf")),
        ("2024.01.03", dt.date(2024, 1, 3)), ("2025.01.01D12:34:56.5", dt.datetime(2025, 1, 1, 12, 34, 56, 500000)), ("2025.01.01T01:00:00", dt.datetime(2025, 1, 1, 1)),
        ("0D00:00:01", dt.timedelta(seconds=1)), ("-2D", dt.timedelta(days=-2)), ("12:30:00", dt.time(12, 30)), ("1 2 3", [1, 2, 3]), ("1 2.5 3", [1.0, 2.5, 3.0]),
        ("4 5 6i", [4, 5, 6]), ("1 2f", [1.0, 2.0]), ("`a`b", ["a", "b"]), ("`a", "a"), ('"x\\ty"', "x\ty"), ("true", True), ("1e3", 1000.0), ("1 0n 3", [1, None, 3]),
    ],
)
def test_literals(source, want):
    assert value(source) == want


def test_folds():
    assert parse("1+2*3") == (("binary", "*", ("binary", "+", ("value", 1), ("value", 2)), ("value", 3)),)
    assert parse("1+2*3", "terse") == (("binary", "+", ("value", 1), ("binary", "*", ("value", 2), ("value", 3))),)


def test_minus():
    assert parse("1 -1") == parse("1-1") == (("binary", "-", ("value", 1), ("value", 1)),)
    assert parse("3*-2") == (("binary", "*", ("value", 3), ("value", -2)),)


def test_elided_arguments():
    assert parse("f(1,,9)")[0][2] == [("value", 1), MISSING, ("value", 9)]
    assert parse("f[1; ; 9]", "terse")[0][2] == [("value", 1), MISSING, ("value", 9)]


def test_query_clauses():
    kind, verb, items, by, source, where, limit = parse("select n: count(i), px by sym from t where a > 1, b = 2 limit -5")[0]
    assert (kind, verb, [n for n, _ in items], by, source, len(where), limit) == ("query", "select", ["n", None], [(None, ("id", "sym"))], ("id", "t"), 2, ("value", -5))


def test_query_as_an_argument_ends_at_the_next_query():
    (call,) = parse("aj(`k, select a from t where b > 1, select c from u)")
    assert [a[0] for a in call[2]] == ["value", "query", "query"]


def test_comments_and_statements():
    assert len(parse("a: 1; // one\n/* two */ b: 2;")) == 2


@pytest.mark.parametrize("source", ["f(1", "select a t", "1 2)", "{a: 1", "€", "if(1) 2"])
def test_problems_tell_the_place(source):
    with pytest.raises(SyntaxProblem, match="line 1"):
        parse(source)


def test_cache():
    parse("1+1")
    hits = parse.cache_info().hits
    parse("1+1")
    assert parse.cache_info().hits == hits + 1


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab1 .`\"'(){}[];,:+-*/<>=0xnwDTselctfrom\n", max_size=40))
def test_any_text_parses_or_is_refused(source):
    for syntax in ("infix", "terse"):
        try:
            parse(source, syntax)
        except (SyntaxProblem, ValueError, TypeError, IndexError, OverflowError):
            pass


def test_every_token_has_its_place():
    tokens = lex("a + `b")
    assert [(t.kind, t.at) for t in tokens] == [("id", 0), ("op", 2), ("sym", 4), ("end", 6)]
