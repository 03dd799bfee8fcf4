"""Syntax trees for both surfaces.

`infix` reads binary operators from left to right and calls with parentheses; `terse` reads from right to left, applies
by juxtaposition and brackets arguments. Neither has operator precedence. Trees are tuples headed by their kind.
"""

from __future__ import annotations

import functools

from .lexer import SyntaxProblem, Token, lex, where

MISSING = ("missing",)
QUERY = ("select", "update", "delete", "exec")


class Parser:
    def __init__(self, source: str, syntax: str):
        self.source, self.terse, self.tokens, self.at = source, syntax == "terse", lex(source), 0
        self.sep = ";" if self.terse else ","

    # tokens

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def next(self) -> Token:
        t = self.now
        self.at += 1
        return t

    def sees(self, kind: str, value=None, ahead: int = 0) -> bool:
        t = self.tokens[min(self.at + ahead, len(self.tokens) - 1)]
        return t.kind == kind and (value is None or t.value == value)

    def punc(self, value: str, ahead: int = 0) -> bool:
        return self.sees("punc", value, ahead)

    def need(self, kind: str, value=None) -> Token:
        if not self.sees(kind, value):
            self.fail(f"expected {value or kind}")
        return self.next()

    def fail(self, what: str):
        raise SyntaxProblem(f"{what}, found {self.now.value!r} at {where(self.source, self.now.at)}")

    # statements

    def program(self) -> list[tuple]:
        out = self.statements(None)
        if not self.sees("end"):
            self.fail("expected a statement")
        return out

    def statements(self, close: str | None) -> list[tuple]:
        out = []
        while not self.sees("end") and not (close and self.punc(close)):
            if self.punc(";"):
                self.next()
                continue
            out.append(self.statement())
            if not self.punc(";") and not (close and self.punc(close)) and not self.sees("end") and out[-1][0] not in ("if", "while", "try"):
                self.fail("expected ;")
        return out

    def statement(self) -> tuple:
        if self.sees("key", "return"):
            self.next()
            return ("return", self.expr())
        if self.terse and self.sees("op", ":"):
            self.next()
            return ("return", self.expr())
        if self.sees("key", "raise"):
            self.next()
            return ("raise", self.expr())
        if self.sees("key", "if"):
            return self.if_()
        if self.sees("key", "while"):
            return self.while_()
        if self.sees("key", "try"):
            return self.try_()
        return self.expr()

    def block(self) -> list[tuple]:
        opens, closes = ("[", "]") if self.terse else ("{", "}")
        self.need("punc", opens)
        out = self.statements(closes)
        self.need("punc", closes)
        return out

    def if_(self) -> tuple:
        self.next()
        if self.terse:
            self.need("punc", "[")
            condition = self.expr()
            self.need("punc", ";")
            then = self.statements("]")
            self.need("punc", "]")
            return ("if", condition, then, [])
        if self.punc("{"):  # if{c, then, c, then, else}
            self.next()
            parts = self.items("}", ",")
            return ("cond", parts)
        self.need("punc", "(")
        condition = self.expr()
        self.need("punc", ")")
        then, other = self.block(), []
        if self.sees("key", "else"):
            self.next()
            other = [self.if_()] if self.sees("key", "if") else self.block()
        return ("if", condition, then, other)

    def while_(self) -> tuple:
        self.next()
        if self.terse:
            self.need("punc", "[")
            condition = self.expr()
            self.need("punc", ";")
            body = self.statements("]")
            self.need("punc", "]")
            return ("while", condition, body)
        self.need("punc", "(")
        condition = self.expr()
        self.need("punc", ")")
        return ("while", condition, self.block())

    def try_(self) -> tuple:
        self.next()
        body = self.block()
        self.need("key", "catch")
        name = "err"
        if not self.terse:
            self.need("punc", "(")
            name = self.need("id").value
            self.need("punc", ")")
        return ("try", body, name, self.block())

    # expressions

    def expr(self) -> tuple:
        if self.sees("key") and self.now.value in QUERY:
            return self.query()
        if self.sees("key", "if"):
            return self.if_()
        left = self.postfix()
        if self.sees("op", ":") and left[0] in ("id", "call"):
            self.next()
            value = self.expr()
            return ("assign", left[1], value) if left[0] == "id" else ("put", left[1], left[2], value)
        return self.right(left) if self.terse else self.left(left)

    def left(self, left: tuple) -> tuple:
        while self.sees("op") and not self.sees("op", ":"):
            op = self.next().value
            left = ("binary", op, left, self.query() if self.sees("key") and self.now.value in QUERY else self.postfix())
        return left

    def right(self, left: tuple) -> tuple:
        if self.sees("op") and not self.sees("op", ":"):
            op = self.next().value
            if self.ends():
                return ("call", left, [("op", op)]) if left[0] == "op" else self.fail("expected an operand")
            return ("binary", op, left, self.expr())
        if self.starts():
            return ("apply", left, self.expr())
        return left

    def ends(self) -> bool:
        return self.sees("end") or self.sees("key") or self.now.kind == "punc" and self.now.value in ")]};,"

    def starts(self) -> bool:
        return self.now.kind in ("value", "str", "sym", "column", "id") or self.now.kind == "punc" and self.now.value in "({" or self.sees("key") and self.now.value in QUERY

    def items(self, close: str, sep: str | None = None) -> list[tuple]:
        """Expressions up to the closing mark; elided ones are MISSING."""
        sep, out = sep or self.sep, []
        if self.punc(close):
            self.next()
            return out
        while True:
            out.append(MISSING if self.punc(sep) or self.punc(close) else self.expr())
            if self.punc(sep):
                self.next()
                continue
            self.need("punc", close)
            return out

    def postfix(self) -> tuple:
        e = self.primary()
        opens, closes = ("[", "]") if self.terse else ("(", ")")
        while self.punc(opens) and e[0] not in ("value",):
            self.next()
            e = ("cond", self.items(closes)) if e == ("op", "$") else ("call", e, self.items(closes))
        return e

    def run(self) -> tuple:
        """A literal, or a vector of literals that follow one another; the last one's suffix holds for all."""
        first = self.next()
        values, suffix = [first.value[0]], first.value[1]
        while self.sees("value") and self.now.spaced:
            t = self.next()
            values.append(t.value[0])
            suffix = t.value[1] or suffix
        if suffix in ("e", "f") and suffix:
            values = [float(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in values]
        elif any(isinstance(v, float) for v in values):
            values = [float(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in values]
        return ("value", values[0] if len(values) == 1 else values)

    def primary(self) -> tuple:
        t = self.now
        if t.kind == "value":
            return self.run()
        if t.kind in ("str", "sym"):
            self.next()
            return ("value", t.value)
        if t.kind == "column":
            self.next()
            return ("column", t.value)
        if t.kind == "id":
            self.next()
            return ("id", t.value)
        if t.kind == "op":
            self.next()
            if t.value == "-" and not self.terse and not self.ends():
                return ("call", ("id", "neg"), [self.postfix()])
            return ("op", t.value)
        if self.sees("key", "function"):
            return self.function()
        if t.kind == "punc" and t.value == "(":
            return self.paren()
        if t.kind == "punc" and t.value == "[":
            self.next()
            return ("list", self.items("]"))
        if t.kind == "punc" and t.value == "{":
            return self.brace()
        self.fail("expected an expression")

    def paren(self) -> tuple:
        start = self.next().at
        if self.punc("[") and self.punc("]", 1):
            self.next()
            self.next()
            pairs = self.pairs(")")
            return ("frame", pairs)
        items = self.items(")", self.sep) if self.terse else self.items(")")
        if len(items) == 1:
            return ("group", items[0]) if items[0][0] == "op" else items[0]
        if not items or self.terse:
            return ("list", items)
        raise SyntaxProblem(f"a list is written with brackets, at {where(self.source, start)}")

    def pairs(self, close: str) -> list[tuple[str | None, tuple]]:
        out = []
        while not self.punc(close):
            if self.punc(self.sep):
                self.next()
                continue
            e = self.expr()
            out.append((e[1], e[2]) if e[0] == "assign" else (e[1] if e[0] == "id" else None, e))
            if not self.punc(close):
                self.need("punc", self.sep)
        self.next()
        return out

    def brace(self) -> tuple:
        if self.terse and self.punc("[", 1):
            start = self.next().at
            self.next()
            params = [p[1] for p in self.items("]")]
            body = self.statements("}")
            end = self.next()
            return ("function", params, body, self.source[start : end.at + 1])
        self.next()
        return ("dict", self.pairs("}"))

    def function(self) -> tuple:
        start = self.next().at
        self.need("punc", "(")
        params = [p[1] for p in self.items(")")]
        self.need("punc", "{")
        body = self.statements("}")
        end = self.next()
        return ("function", params, body, self.source[start : end.at + 1])

    # queries

    def query(self) -> tuple:
        kind = self.next().value
        items = self.clauses(("by", "from"))
        by = []
        if self.sees("key", "by"):
            self.next()
            by = self.clauses(("from",))
        self.need("key", "from")
        source = self.expr()
        conditions, limit = [], None
        if self.sees("key", "where"):
            self.next()
            conditions = [e for _, e in self.clauses(("limit",))]
        if self.sees("key", "limit"):
            self.next()
            limit = self.expr()
        return ("query", kind, items, by, source, conditions, limit)

    def clauses(self, stop: tuple[str, ...]) -> list[tuple[str | None, tuple]]:
        out = []
        while not (self.sees("key") and self.now.value in stop) and not self.ends_query() and not (self.punc(",") and out):
            e = self.expr()
            out.append((e[1], e[2]) if e[0] == "assign" else (None, e))
            if self.punc(",") and self.sees("key", None, 1) and self.tokens[self.at + 1].value in QUERY:
                break  # the next argument of a call
            if self.punc(","):
                self.next()
        return out

    def ends_query(self) -> bool:
        return self.sees("end") or self.now.kind == "punc" and self.now.value in ")]};"


@functools.lru_cache(maxsize=256)
def parse(source: str, syntax: str = "infix") -> tuple[tuple, ...]:
    """The program's statements; the last 256 sources are kept."""
    if syntax not in ("infix", "terse"):
        raise ValueError(f"no syntax {syntax!r}")
    return tuple(Parser(source, syntax).program())
