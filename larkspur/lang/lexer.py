"""Tokens of both syntaxes."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass
from decimal import Decimal
from typing import Any

#: Words that stand between their operands.
INFIX_WORDS = set(
    """as bottom corr cov0 cov1 cross differ div each emean equal estd evar explode extend fby gather hstack in intersect
    join like log match matches mmax mmean mmedian mmin mod mskew mstd0 mstd1 msum mvar0 mvar1 pad parallel pow quantile
    reshape rotate round set shift split ss ssr sub top union upsert vstack within wmean wsum xasc xbar xdesc xrename
    xreorder""".split()
)
KEYWORDS = {"function", "if", "else", "while", "try", "catch", "return", "raise", "select", "update", "delete", "exec", "by", "from", "where", "limit"}


class SyntaxProblem(ValueError):
    """Source that can't be read, with its line and column."""


class Sym(str):
    """A symbol: an interned name, as against text."""

    __slots__ = ()

    def __repr__(self) -> str:
        return f"`{self}"


@dataclass(frozen=True)
class Token:
    kind: str  # value, run, str, sym, column, id, op, punc, key, end
    value: Any
    at: int
    spaced: bool  # white space before it


_TIME = r"\d\d:\d\d:\d\d(?:\.\d{0,9})?"
_DATE = r"\d{4,}\.\d\d\.\d\d"
_PATTERNS = [
    ("skip", r"\s+|//[^\n]*|/\*.*?\*/"),
    ("stamp", rf"{_DATE}D(?:{_TIME})?"),
    ("moment", rf"{_DATE}T(?:{_TIME})?"),
    ("date", _DATE),
    ("span", rf"\d+D(?:{_TIME})?"),
    ("time", _TIME),
    ("hex", r"0x(?:[0-9a-fA-F]{2})+"),
    ("bits", r"[01]+b(?![A-Za-z0-9_])"),
    ("null", r"0n(?:[hiuef](?:\d+)?)?(?![A-Za-z_])"),
    ("inf", r"0w(?:[ef](?:\d+)?)?(?![A-Za-z_])"),
    ("num", r"(?:\d+\.\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+|\d+)(?:[hiuef](?:\d+)?)?(?![A-Za-z_])"),
    ("str", r'"(?:[^"\\]|\\.)*"'),
    ("column", r"'(?:[^'\\]|\\.)*'"),
    ("sym", r"(?:`[A-Za-z0-9.:/_\\-]*)+"),
    ("id", r"(?:\.[A-Za-z_][A-Za-z0-9_]*|[A-Za-z_][A-Za-z0-9_]*)(?:\.[A-Za-z_][A-Za-z0-9_]*)*"),
    ("short", r"\|\||&&|\?\?"),
    ("op", r"\+\+|!=|<=|>=|[+*\-/!<>=:.$?@~_&|#^%]"),
    ("punc", r"[()\[\]{};,]"),
]
_SCANNER = re.compile("|".join(f"(?P<{k}>{p})" for k, p in _PATTERNS), re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


class Typed:
    """A number with a declared width: h, i (integers), e (short float); compares and counts as its value."""

    def __new__(cls, value, suffix: str):
        return float(value) if suffix[0] in "ef" else int(value)


def _clock(text: str) -> dt.timedelta:
    h, m, s = text.split(":")
    return dt.timedelta(hours=int(h), minutes=int(m), microseconds=int(Decimal(s or "0") * 1_000_000))


def _date(text: str) -> dt.date:
    y, m, d = text.split(".")
    return dt.date(int(y), int(m), int(d))


def _literal(kind: str, text: str) -> Any:
    if kind == "date":
        return _date(text)
    if kind in ("stamp", "moment"):
        day, _, clock = text.partition("D" if kind == "stamp" else "T")
        return dt.datetime.combine(_date(day), dt.time()) + (_clock(clock) if clock else dt.timedelta())
    if kind == "time":
        return (dt.datetime.min + _clock(text)).time()
    if kind == "span":
        days, _, clock = text.partition("D")
        return dt.timedelta(days=int(days)) + (_clock(clock) if clock else dt.timedelta())
    if kind == "hex":
        raw = list(bytes.fromhex(text[2:]))
        return raw[0] if len(raw) == 1 else raw
    if kind == "bits":
        bits = [c == "1" for c in text[:-1]]
        return bits[0] if len(bits) == 1 else bits
    if kind == "null":
        return None
    if kind == "inf":
        return float("inf")
    if re.fullmatch(r"[\d.]+[eE][+-]?\d+", text):
        return float(text)
    m = re.fullmatch(r"(.*?)([hiuef]\d*)?", text)
    number, suffix = m[1], m[2]
    if suffix:
        return Typed(number, suffix)
    return float(number) if re.search(r"[.eE]", number) else int(number)


def unquote(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S)


def where(source: str, at: int) -> str:
    line = source.count("\n", 0, at) + 1
    return f"line {line}, column {at - source.rfind('\n', 0, at)}"


def lex(source: str) -> list[Token]:
    """All tokens, ended by one of kind `end`. A minus before a number is its sign unless a value stands before it."""
    out: list[Token] = []
    at, spaced, minus = 0, False, None
    while at < len(source):
        m = _SCANNER.match(source, at)
        if not m:
            raise SyntaxProblem(f"can't read {source[at : at + 10]!r} at {where(source, at)}")
        kind, text = m.lastgroup, m[0]
        at, began = m.end(), m.start()
        if kind == "skip":
            spaced = True
            continue
        if kind in ("stamp", "moment", "date", "span", "time", "hex", "bits", "null", "inf", "num"):
            value = _literal(kind, text)
            if minus is not None and minus == began and isinstance(value, (int, float, dt.timedelta)):
                out.pop()
                value, spaced = -value, out_spaced
            suffix = m[0][-1] if kind == "num" and m[0][-1] in "hiuef" else ""
            out.append(Token("value", (value, suffix), began, spaced))
        elif kind == "str":
            out.append(Token("str", unquote(text), began, spaced))
        elif kind == "column":
            out.append(Token("column", unquote(text), began, spaced))
        elif kind == "sym":
            names = [Sym(x) for x in text.split("`")[1:]]
            out.append(Token("sym", names[0] if len(names) == 1 else names, began, spaced))
        elif kind == "id":
            out.append(Token("value", (text == "true", ""), began, spaced) if text in ("true", "false") else Token("key" if text in KEYWORDS else "op" if text in INFIX_WORDS or text == "_" else "id", text, began, spaced))
        else:
            before = out[-1] if out else None
            ends_value = before is not None and (before.kind in ("value", "str", "sym", "column", "id") or before.kind == "punc" and before.value in ")]}")
            minus = at if text == "-" and not ends_value else None
            out_spaced = spaced
            out.append(Token("punc" if kind == "punc" else "op", text, began, spaced))
        if out[-1].value != "-":
            minus = None
        spaced = False
    out.append(Token("end", None, len(source), spaced))
    return out
