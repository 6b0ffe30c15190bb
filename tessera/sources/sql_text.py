"""The dialect's text: tokens, statements and syntax trees.

Expressions become small nodes; queries become dictionaries. Precedence is the standard one: OR, AND,
NOT, comparisons, bit operators, + and - and ||, * / %, unary.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any


class DialectError(ValueError):
    """A statement that the dialect does not accept or cannot run."""


@dataclass
class Token:
    kind: str  # word, name, text, number, op
    text: str

    @property
    def key(self) -> str:
        return self.text.upper() if self.kind in ("word", "op") else ""


_TOKEN = re.compile(
    r"""(?P<skip>\s+|--[^\n]*|/\*.*?\*/)
      | (?P<number>\d+\.\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+|\d+)
      | (?P<text>'(?:[^']|'')*')
      | (?P<name>"[^"]*"|`[^`]*`|\[[^\]]*\])
      | (?P<word>[^\W\d]\w*)
      | (?P<op>\|\||<<|>>|<=|>=|<>|!=|==|[-+*/%&|~<>=(),.;])""",
    re.X | re.S,
)


def tokens(sql: str) -> list[Token]:
    out, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            raise DialectError(f"unexpected character {sql[at]!r}")
        at, kind = m.end(), m.lastgroup
        text = m.group()
        if kind == "text":
            text = text[1:-1].replace("''", "'")
        elif kind == "name":
            text = text[1:-1]
        if kind != "skip":
            out.append(Token(kind, text))
    return out


def statements(script: str) -> list[list[Token]]:
    """The token lists of a script's statements; a semicolon ends one, and the last may go without."""
    out: list[list[Token]] = [[]]
    for token in tokens(script):
        if token.key == ";":
            out.append([])
        else:
            out[-1].append(token)
    return [s for s in out if s]


@dataclass
class Node:
    kind: str
    value: Any = None
    args: list[Any] = field(default_factory=list)
    extra: dict[str, Any] = field(default_factory=dict)


_RESERVED = set("SELECT FROM WHERE GROUP HAVING ORDER LIMIT OFFSET UNION INTERSECT EXCEPT JOIN INNER LEFT RIGHT FULL CROSS NATURAL ON USING AS AND OR NOT IN IS LIKE GLOB BETWEEN CASE WHEN THEN ELSE END SET VALUES RETURNING WINDOW".split())


class Parser:
    def __init__(self, found: list[Token]):
        self.tokens, self.at = found, 0

    # tokens
    def peek(self, *keys: str, ahead: int = 0) -> bool:
        at = self.at + ahead
        return at < len(self.tokens) and self.tokens[at].key in keys

    def take(self, *keys: str) -> bool:
        """Consume the given words or signs if all of them come next."""
        if all(self.peek(k, ahead=i) for i, k in enumerate(keys)):
            self.at += len(keys)
            return True
        return False

    def need(self, *keys: str) -> None:
        if not self.take(*keys):
            raise DialectError(f"expected {' '.join(keys)} near {self.near()}")

    def near(self) -> str:
        return " ".join(t.text for t in self.tokens[self.at : self.at + 3]) or "the end"

    def done(self) -> None:
        if self.at < len(self.tokens):
            raise DialectError(f"unexpected {self.near()}")

    def name(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at].kind in ("word", "name"):
            self.at += 1
            return self.tokens[self.at - 1].text
        raise DialectError(f"expected a name near {self.near()}")

    def integer(self) -> int:
        minus = self.take("-")
        if self.at < len(self.tokens) and self.tokens[self.at].kind == "number":
            self.at += 1
            return int(self.tokens[self.at - 1].text) * (-1 if minus else 1)
        raise DialectError(f"expected a number near {self.near()}")

    def listed(self, one) -> list:
        out = [one()]
        while self.take(","):
            out.append(one())
        return out

    def names(self) -> list[str]:
        self.need("(")
        out = self.listed(self.name)
        self.need(")")
        return out

    # expressions
    def expr(self) -> Node:
        left = self.both()
        while self.take("OR"):
            left = Node("or", args=[left, self.both()])
        return left

    def both(self) -> Node:
        left = self.negated()
        while self.take("AND"):
            left = Node("and", args=[left, self.negated()])
        return left

    def negated(self) -> Node:
        if self.peek("NOT") and not self.peek("EXISTS", ahead=1):
            self.take("NOT")
            return Node("not", args=[self.negated()])
        return self.compared()

    def compared(self) -> Node:
        left = self.bits()
        while True:
            if self.take("IS"):
                off = self.take("NOT")
                if self.take("NULL"):
                    left = Node("isnull", off, [left])
                else:
                    self.take("DISTINCT", "FROM")
                    left = Node("is", off, [left, self.bits()])
                continue
            off = self.peek("NOT") and self.peek("IN", "LIKE", "GLOB", "BETWEEN", ahead=1) and self.take("NOT")
            if self.take("BETWEEN"):
                low = self.bits()
                self.need("AND")
                left = Node("between", off, [left, low, self.bits()])
            elif self.take("IN"):
                self.need("(")
                if self.peek("SELECT", "WITH", "VALUES"):
                    left = Node("in_query", off, [left, self.query()])
                else:
                    left = Node("in", off, [left, *([] if self.peek(")") else self.listed(self.expr))])
                self.need(")")
            elif self.take("LIKE"):
                left = Node("like", off, [left, self.bits()])
            elif self.take("GLOB"):
                left = Node("glob", off, [left, self.bits()])
            elif self.peek("=", "==", "!=", "<>", "<", "<=", ">", ">="):
                sign = {"==": "=", "!=": "<>"}.get(self.tokens[self.at].key, self.tokens[self.at].key)
                self.at += 1
                left = Node("compare", sign, [left, self.bits()])
            else:
                return left

    def _chain(self, below, *signs: str) -> Node:
        left = below()
        while self.peek(*signs):
            sign = self.tokens[self.at].key
            self.at += 1
            left = Node("binary", sign, [left, below()])
        return left

    def bits(self) -> Node:
        return self._chain(self.sums, "&", "|", "<<", ">>")

    def sums(self) -> Node:
        return self._chain(self.products, "+", "-")

    def products(self) -> Node:
        return self._chain(self.joined, "*", "/", "%")

    def joined(self) -> Node:
        return self._chain(self.unary, "||")

    def unary(self) -> Node:
        for sign in "-+~":
            if self.take(sign):
                return Node("unary", sign, [self.unary()])
        return self.primary()

    def primary(self) -> Node:
        if self.at >= len(self.tokens):
            raise DialectError("the statement ends within an expression")
        token = self.tokens[self.at]
        if token.kind == "number":
            self.at += 1
            return Node("number", token.text)
        if token.kind == "text":
            self.at += 1
            return Node("text", token.text)
        if self.take("NULL"):
            return Node("null")
        if self.peek("EXISTS") or (self.peek("NOT") and self.peek("EXISTS", ahead=1)):
            off = self.take("NOT")
            self.need("EXISTS", "(")
            out = Node("exists", off, [self.query()])
            self.need(")")
            return out
        if self.take("("):
            if self.peek("SELECT", "WITH"):
                out = Node("scalar", args=[self.query()])
            else:
                out = self.expr()
            self.need(")")
            return out
        if self.take("CASE"):
            base = None if self.peek("WHEN") else self.expr()
            arms = []
            while self.take("WHEN"):
                test = self.expr()
                self.need("THEN")
                arms.append((Node("compare", "=", [base, test]) if base else test, self.expr()))
            other = self.expr() if self.take("ELSE") else None
            self.need("END")
            return Node("case", other, arms)
        if self.take("CAST", "("):
            inner = self.expr()
            self.need("AS")
            kind = self.declared()
            self.need(")")
            return Node("cast", kind, [inner])
        called = self.peek("(", ahead=1) and (token.kind == "name" or token.key not in _RESERVED or token.key in ("LEFT", "RIGHT", "LIKE", "GLOB"))
        if token.kind in ("word", "name") and called:
            return self.call()
        if token.kind == "word" and token.key in _RESERVED:
            raise DialectError(f"unexpected {self.near()}")
        first = self.name()
        return Node("column", (first, self.name())) if self.take(".") else Node("column", (None, first))

    def call(self) -> Node:
        out = Node("call", self.name().lower())
        self.need("(")
        out.extra["distinct"] = self.take("DISTINCT")
        if self.take("*"):
            out.extra["star"] = True
        elif not self.peek(")"):
            out.args = self.listed(self.expr)
        self.need(")")
        if self.take("OVER", "("):
            out.extra["partition"] = self.listed(self.expr) if self.take("PARTITION", "BY") else []
            out.extra["order"] = self.listed(self.ordering) if self.take("ORDER", "BY") else []
            frame = []
            while not self.peek(")"):
                frame.append(self.tokens[self.at].text)
                self.at += 1
            self.need(")")
            out.extra["over"] = True
            out.extra["frame"] = " ".join(frame)
        return out

    def ordering(self) -> tuple[Node, str]:
        by = self.expr()
        way = "DESC" if self.take("DESC") else "ASC"
        self.take("ASC")
        if self.take("NULLS"):
            way += " NULLS FIRST" if self.take("FIRST") else " NULLS LAST"
            self.take("LAST")
        return by, way

    def declared(self) -> str:
        """A declared type as one of INTEGER, REAL, TEXT."""
        name = self.name().upper()
        while self.at < len(self.tokens) and self.tokens[self.at].kind == "word" and self.tokens[self.at].key in ("PRECISION", "VARYING", "INT", "INTEGER", "UNSIGNED"):
            self.at += 1
        if self.take("("):
            self.listed(self.integer)
            self.need(")")
        return column_type(name)

    # queries
    def query(self) -> dict:
        out: dict[str, Any] = {"ctes": [], "recursive": False, "order": [], "limit": None, "offset": None}
        if self.take("WITH"):
            out["recursive"] = self.take("RECURSIVE")

            def cte():
                name = self.name()
                columns = self.names() if self.peek("(") else []
                self.need("AS", "(")
                inner = self.query()
                self.need(")")
                return name, columns, inner

            out["ctes"] = self.listed(cte)
        out["cores"], out["sets"] = [self.core()], []
        while self.peek("UNION", "INTERSECT", "EXCEPT"):
            sign = self.tokens[self.at].key
            self.at += 1
            out["sets"].append(sign + (" ALL" if self.take("ALL") else ""))
            out["cores"].append(self.core())
        if self.take("ORDER", "BY"):
            out["order"] = self.listed(self.ordering)
        if self.take("LIMIT"):
            out["limit"] = self.integer()
            if self.take(","):
                out["offset"], out["limit"] = out["limit"], self.integer()
        if self.take("OFFSET"):
            out["offset"] = self.integer()
        return out

    def core(self) -> dict:
        out: dict[str, Any] = {"distinct": False, "items": [], "from": [], "where": None, "group": [], "having": None}
        if self.take("VALUES"):
            rows = self.listed(self.row)
            out["values"] = rows
            return out
        self.need("SELECT")
        out["distinct"] = self.take("DISTINCT")
        self.take("ALL")
        out["items"] = self.listed(self.item)
        if self.take("FROM"):
            out["from"] = [("", self.source(), None)]
            while True:
                if self.take(","):
                    out["from"].append((",", self.source(), None))
                    continue
                natural = self.take("NATURAL")
                kind = next((k for k in ("INNER", "LEFT", "RIGHT", "FULL", "CROSS") if self.take(k)), "")
                self.take("OUTER")
                if not self.take("JOIN"):
                    break
                source = self.source()
                on: Any = None
                if self.take("ON"):
                    on = self.expr()
                elif self.peek("USING"):
                    self.take("USING")
                    on = self.names()
                out["from"].append((("NATURAL " if natural else "") + (kind or "INNER"), source, on))
        if self.take("WHERE"):
            out["where"] = self.expr()
        if self.take("GROUP", "BY"):
            out["group"] = self.listed(self.expr)
        if self.take("HAVING"):
            out["having"] = self.expr()
        return out

    def row(self) -> list[Node]:
        self.need("(")
        out = self.listed(self.expr)
        self.need(")")
        return out

    def item(self) -> tuple[Node, str | None]:
        if self.take("*"):
            return Node("star"), None
        if self.peek(".", ahead=1) and self.peek("*", ahead=2):
            name = self.name()
            self.need(".", "*")
            return Node("star", name), None
        return self.expr(), self.alias()

    def alias(self) -> str | None:
        if self.take("AS"):
            return self.name()
        if self.at < len(self.tokens) and (self.tokens[self.at].kind == "name" or (self.tokens[self.at].kind == "word" and self.tokens[self.at].key not in _RESERVED)):
            return self.name()
        return None

    def source(self) -> tuple[Any, str | None]:
        if self.take("("):
            inner = self.query()
            self.need(")")
            return inner, self.alias()
        return self.name(), self.alias()


def column_type(declared: str) -> str:
    if declared in ("INTEGER", "INT", "TINYINT", "SMALLINT", "MEDIUMINT", "BIGINT", "BOOLEAN", "NUMERIC"):
        return "INTEGER"
    return "REAL" if declared in ("REAL", "DOUBLE", "FLOAT", "DECIMAL") else "TEXT"
