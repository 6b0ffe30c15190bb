"""From the dialect's syntax trees to Spark SQL text.

Types are inferred on the way, as the dialect's operators depend on them: / and % of integers
truncate, || and friends write numbers as text, and conditions are 0 or 1 where a value is wanted.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from ..functions.compat import strftime_pattern
from .sql_text import DialectError, Node

INT, REAL, TEXT, BOOL, NULL = "int", "real", "text", "bool", "null"
_AGGREGATES = {"count", "sum", "avg", "min", "max", "total", "group_concat"}
_RANKS = {"row_number", "rank", "dense_rank", "ntile"}
_INTS = {"length", "instr", "unicode", "sign", "changes", "total_changes", "last_insert_rowid", "random"}
_TEXTS = {"upper", "lower", "trim", "ltrim", "rtrim", "substr", "substring", "replace", "hex", "char", "zeroblob", "printf", "quote", "typeof", "date", "time", "datetime", "strftime", "group_concat"}
_REALS = {"round", "sqrt", "power", "pow", "log", "log10", "log2", "ln", "exp", "acos", "asin", "atan", "atan2", "cos", "sin", "tan", "pi", "mod", "avg", "total"}
_DOMAIN = {"sqrt": "t_sqrt", "log10": "t_log10", "log2": "t_log2", "ln": "t_ln", "acos": "t_acos", "asin": "t_asin", "exp": "exp", "atan": "atan", "cos": "cos", "sin": "sin", "tan": "tan"}


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text_literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


class Scope:
    """Columns in sight: by qualified and by bare name."""

    def __init__(self, outer: Scope | None = None):
        self.outer, self.sources = outer, {}

    def add(self, name: str, columns: dict[str, str]) -> None:
        self.sources[name.lower()] = {k.lower(): v for k, v in columns.items()}

    def kind(self, source: str | None, column: str) -> str | None:
        found = [self.sources.get(source.lower(), {})] if source else self.sources.values()
        for columns in found:
            if column.lower() in columns:
                return columns[column.lower()]
        return self.outer.kind(source, column) if self.outer else None

    def holds(self, column: str) -> bool:
        return any(column.lower() in c for c in self.sources.values())


class Translator:
    """``lookup`` gives a table's Spark name and its columns with their types; ``counters`` the values of the counting functions."""

    def __init__(self, lookup: Callable[[str], tuple[str, dict[str, str]]], counters: dict[str, int]):
        self.lookup, self.counters = lookup, counters
        self.ctes: list[dict[str, dict[str, str]]] = []

    # types
    def kind(self, n: Node, s: Scope) -> str:
        k = n.kind
        if k == "number":
            return INT if n.value.isdigit() else REAL
        if k in ("and", "or", "not", "compare", "isnull", "is", "between", "in", "in_query", "like", "glob", "exists"):
            return BOOL
        if k == "column":
            return s.kind(*n.value) or TEXT
        if k == "unary":
            return INT if n.value == "~" else self._number(n.args[0], s)
        if k == "binary":
            if n.value == "||":
                return TEXT
            if n.value in ("&", "|", "<<", ">>"):
                return INT
            return REAL if REAL in (self._number(x, s) for x in n.args) else INT
        if k == "case":
            return self._common([v for _, v in n.args] + ([n.value] if n.value else []), s)
        if k == "cast":
            return {"INTEGER": INT, "REAL": REAL}.get(n.value, TEXT)
        if k == "first":
            return self.kind(n.args[0], s)
        if k == "scalar":
            return next(iter(self.shape(n.args[0], s).values()), TEXT)
        if k == "call":
            name = n.value
            if name == "count" or name in _RANKS or name in _INTS:
                return INT
            if name in _TEXTS:
                return TEXT
            if name in _REALS:
                return REAL
            if name in ("like", "glob"):
                return BOOL
            if name == "iif":
                return self._common(n.args[1:], s)
            if name in ("abs", "sum", "ceil", "ceiling", "floor"):
                return self._number(n.args[0], s) if n.args else INT
            if name in ("lag", "lead"):
                return self._common([n.args[0], *n.args[2:]], s)
            return self._common(n.args, s)
        return NULL if k == "null" else TEXT

    def _number(self, n: Node, s: Scope) -> str:
        k = self.kind(n, s)
        return INT if k in (INT, BOOL, NULL) or self._digits(n) else REAL

    @staticmethod
    def _digits(n: Node) -> bool:
        """Whether a text literal is a whole number."""
        return n.kind == "text" and n.value.strip().lstrip("+-").isdigit()

    def _common(self, nodes: list[Node], s: Scope) -> str:
        kinds = {INT if k == BOOL else k for k in (self.kind(x, s) for x in nodes)} - {NULL}
        if not kinds:
            return NULL
        if TEXT in kinds:
            return TEXT
        return REAL if REAL in kinds else INT

    # forms of an expression
    def value(self, n: Node, s: Scope) -> str:
        """As a value; a condition is 0 or 1."""
        out = self._raw(n, s)
        return f"CAST({out} AS BIGINT)" if self.kind(n, s) == BOOL else out

    def test(self, n: Node, s: Scope) -> str:
        """As a condition; a number is true unless 0."""
        k = self.kind(n, s)
        if k == BOOL:
            return self._raw(n, s)
        if k == NULL:
            return "CAST(NULL AS BOOLEAN)"
        if k == TEXT:
            return f"(coalesce(try_cast({self.value(n, s)} AS DOUBLE), 0D) <> 0)"
        return f"({self.value(n, s)} <> 0)"

    def number(self, n: Node, s: Scope) -> str:
        k = self.kind(n, s)
        if self._digits(n):
            return f"{int(n.value)}L"
        if k == TEXT:
            return f"coalesce(try_cast({self.value(n, s)} AS DOUBLE), 0D)"
        return "CAST(NULL AS BIGINT)" if k == NULL else self.value(n, s)

    def real(self, n: Node, s: Scope) -> str:
        return f"CAST({self.number(n, s)} AS DOUBLE)"

    def text(self, n: Node, s: Scope) -> str:
        k = self.kind(n, s)
        if k == TEXT:
            return self.value(n, s)
        return f"t_fmt15({self.value(n, s)})" if k == REAL else f"CAST({self.value(n, s)} AS STRING)"

    def _as(self, n: Node, kind: str, s: Scope) -> str:
        if kind == TEXT:
            return self.text(n, s)
        return self.real(n, s) if kind == REAL else self.value(n, s)

    def _alike(self, nodes: list[Node], s: Scope) -> list[str]:
        kind = self._common(nodes, s)
        return [self._as(x, kind, s) for x in nodes]

    def _pair(self, a: Node, b: Node, s: Scope) -> tuple[str, str]:
        """Two sides of a comparison: text against a number compares as numbers where the text is one."""
        ka, kb = self.kind(a, s), self.kind(b, s)
        x, y = self.value(a, s), self.value(b, s)
        if ka == TEXT and kb in (INT, REAL, BOOL):
            x = f"try_cast({x} AS DOUBLE)"
        if kb == TEXT and ka in (INT, REAL, BOOL):
            y = f"try_cast({y} AS DOUBLE)"
        return x, y

    def _raw(self, n: Node, s: Scope) -> str:
        k, a = n.kind, n.args
        off = "NOT " if n.value is True else ""
        if k == "number":
            return n.value + ("L" if n.value.isdigit() else "D")
        if k == "text":
            return text_literal(n.value)
        if k == "null":
            return "NULL"
        if k == "column":
            source, name = n.value
            return (quoted(source) + "." if source else "") + quoted(name)
        if k in ("and", "or"):
            return f"({self.test(a[0], s)} {k.upper()} {self.test(a[1], s)})"
        if k == "not":
            return f"(NOT {self.test(a[0], s)})"
        if k == "compare":
            x, y = self._pair(a[0], a[1], s)
            return f"({x} {n.value} {y})"
        if k == "is":
            x, y = self._pair(a[0], a[1], s)
            return f"({off}({x} <=> {y}))"
        if k == "isnull":
            return f"({self.value(a[0], s)} IS {off}NULL)"
        if k == "between":
            lo, hi = self._pair(a[0], a[1], s), self._pair(a[0], a[2], s)
            return f"({off}({lo[0]} >= {lo[1]} AND {hi[0]} <= {hi[1]}))"
        if k == "in":
            if len(a) == 1:
                return "TRUE" if n.value else "FALSE"
            return f"({off}({' OR '.join(' = '.join(self._pair(a[0], x, s)) for x in a[1:])}))"
        if k == "in_query":
            return f"({self.value(a[0], s)} {off}IN ({self.query(a[1], s)}))"
        if k == "exists":
            return f"({off}EXISTS ({self.query(a[0], s)}))"
        if k == "like":
            return f"({off}t_like({self.text(a[1], s)}, {self.text(a[0], s)}))"
        if k == "glob":
            return f"({off}t_glob({self.text(a[1], s)}, {self.text(a[0], s)}))"
        if k == "unary":
            return f"({'' if n.value == '+' else n.value}{self.number(a[0], s)})"
        if k == "binary":
            return self._binary(n, s)
        if k == "case":
            values = self._alike([v for _, v in a] + ([n.value] if n.value else []), s)
            arms = "".join(f" WHEN {self.test(t, s)} THEN {v}" for (t, _), v in zip(a, values, strict=False))
            return f"CASE{arms}{' ELSE ' + values[-1] if n.value else ''} END"
        if k == "cast":
            if n.value == "TEXT":
                return self.text(a[0], s)
            if n.value == "REAL":
                return self.real(a[0], s)
            return f"t_cast_int({self.value(a[0], s)})" if self.kind(a[0], s) == TEXT else f"CAST({self.value(a[0], s)} AS BIGINT)"
        if k == "first":
            return f"first({self.value(a[0], s)})"
        if k == "scalar":
            return f"({self.query(a[0], s, first_row=True)})"
        if k == "call":
            return self._call(n, s)
        raise DialectError(f"no expression: {k}")

    def _binary(self, n: Node, s: Scope) -> str:
        a, b = n.args
        sign, kind = n.value, self.kind(n, s)
        if sign == "||":
            return f"concat({self.text(a, s)}, {self.text(b, s)})"
        if sign in ("<<", ">>"):
            return f"{'t_shl' if sign == '<<' else 't_shr'}(CAST({self.number(a, s)} AS BIGINT), CAST({self.number(b, s)} AS BIGINT))"
        if sign in ("&", "|"):
            return f"(CAST({self.number(a, s)} AS BIGINT) {sign} CAST({self.number(b, s)} AS BIGINT))"
        if sign == "/":
            return f"({self.number(a, s)} div nullif({self.number(b, s)}, 0))" if kind == INT else f"({self.real(a, s)} / nullif({self.real(b, s)}, 0D))"
        if sign == "%":
            return f"({self.number(a, s)} % nullif({self.number(b, s)}, 0))"
        return f"({self.number(a, s)} {sign} {self.number(b, s)})"

    def _call(self, n: Node, s: Scope) -> str:
        name, a = n.value, n.args
        over = n.extra.get("over")
        if over or name in _RANKS or (name in _AGGREGATES and (len(a) < 2 or name == "group_concat")):
            out = self._aggregate(n, s)
            if not over:
                return out
            parts = []
            if n.extra["partition"]:
                parts.append("PARTITION BY " + ", ".join(self.value(x, s) for x in n.extra["partition"]))
            if n.extra["order"]:
                parts.append("ORDER BY " + ", ".join(f"{self.value(x, s)} {way}" for x, way in n.extra["order"]))
            parts.append(n.extra["frame"])
            window = f"OVER ({' '.join(p for p in parts if p)})"
            if name == "total":
                return f"coalesce(sum({self.real(a[0], s)}) {window}, 0D)"
            return f"CAST({out} {window} AS BIGINT)" if name in _RANKS else f"{out} {window}"
        t = [self.text(x, s) for x in a] if name in _TEXTS | {"length", "instr", "unicode", "like", "glob"} else []
        if name in ("length", "upper", "lower", "unicode", "hex", "date", "time", "datetime"):
            return f"t_{name}({t[0] if t else text_literal('now')})"
        if name in ("instr", "like", "glob"):
            return f"t_{name}({t[0]}, {t[1]})"
        if name in ("trim", "ltrim", "rtrim"):
            return f"{name}({t[0]})" if len(t) == 1 else f"{ {'trim': 'btrim'}.get(name, name)}({t[0] if name == 'trim' else t[1]}, {t[1] if name == 'trim' else t[0]})"
        if name in ("substr", "substring"):
            at = [f"CAST({self.number(x, s)} AS BIGINT)" for x in a[1:]]
            return f"t_substr({t[0]}, {at[0]}, {at[1]})" if len(at) > 1 else f"t_substr2({t[0]}, {at[0]})"
        if name == "replace":
            return f"replace({', '.join(t)})"
        if name == "char":
            return "concat(" + ", ".join(f"char({self.number(x, s)})" for x in a) + ")" if a else "''"
        if name == "zeroblob":
            return f"t_zeroblob({self.number(a[0], s)})"
        if name == "printf":
            return t[0] if len(a) == 1 else f"format_string({t[0]}, {', '.join(self.value(x, s) for x in a[1:])})"
        if name == "quote":
            return f"{'t_quote' if self.kind(a[0], s) == TEXT else 't_quote_number'}({self.text(a[0], s)})"
        if name == "strftime":
            if a[0].kind != "text":
                raise DialectError("strftime takes a literal format")
            return f"date_format(t_parse_dt({t[1] if len(t) > 1 else text_literal('now')}), {text_literal(strftime_pattern(a[0].value))})"
        if name == "typeof":
            word = {INT: "integer", BOOL: "integer", REAL: "real", NULL: "null"}.get(self.kind(a[0], s), "text")
            return f"CASE WHEN {self.value(a[0], s)} IS NULL THEN 'null' ELSE '{word}' END"
        if name in ("coalesce", "ifnull"):
            return f"coalesce({', '.join(self._alike(a, s))})"
        if name == "nullif":
            x, y = self._pair(a[0], a[1], s)
            return f"CASE WHEN {x} = {y} THEN NULL ELSE {self.value(a[0], s)} END"
        if name == "iif":
            x, y = self._alike(a[1:], s)
            return f"CASE WHEN {self.test(a[0], s)} THEN {x} ELSE {y} END"
        if name in ("max", "min"):
            return f"{'greatest' if name == 'max' else 'least'}({', '.join(self._alike(a, s))})"
        if name == "random":
            return "t_random()"
        if name in self.counters:
            return f"{self.counters[name]}L"
        if name == "pi":
            return "pi()"
        if name == "abs":
            return f"abs({self.number(a[0], s)})"
        if name == "sign":
            return f"t_sign({self.real(a[0], s)})"
        if name == "round":
            if len(a) == 1 or a[1].kind == "number":
                return f"round({self.real(a[0], s)}, {int(float(a[1].value)) if len(a) > 1 else 0})"
            by = f"power(10D, greatest(CAST({self.number(a[1], s)} AS INT), 0))"  # places below zero are none
            return f"(round({self.real(a[0], s)} * {by}) / {by})"
        if name in ("ceil", "ceiling", "floor"):
            return self.number(a[0], s) if self._number(a[0], s) == INT else f"t_{name[:5].replace('ceili', 'ceil')}({self.real(a[0], s)})"
        if name == "log":
            return f"t_log10({self.real(a[0], s)})" if len(a) == 1 else f"t_log({self.real(a[0], s)}, {self.real(a[1], s)})"
        if name in ("power", "pow"):
            return f"power({self.real(a[0], s)}, {self.real(a[1], s)})"
        if name in ("mod", "atan2"):
            return f"{'t_mod' if name == 'mod' else name}({self.real(a[0], s)}, {self.real(a[1], s)})"
        if name in _DOMAIN:
            return f"{_DOMAIN[name]}({self.real(a[0], s)})"
        raise DialectError(f"no such function: {name}")

    def _aggregate(self, n: Node, s: Scope) -> str:
        name, a, once = n.value, n.args, "DISTINCT " if n.extra.get("distinct") else ""
        if name == "count":
            return "count(*)" if n.extra.get("star") or not a else f"count({once}{self.value(a[0], s)})"
        if name in ("sum", "avg"):
            inner = f"try_cast({self.value(a[0], s)} AS DOUBLE)" if self.kind(a[0], s) == TEXT else self.number(a[0], s)
            return f"{name}({once}{inner})"
        if name in ("min", "max"):
            return f"{name}({self.value(a[0], s)})"
        if name == "total":
            return f"coalesce(sum({self.real(a[0], s)}), 0D)"
        if name == "group_concat":
            gap = text_literal(a[1].value) if len(a) > 1 else "','"
            return f"listagg({once}{self.text(a[0], s)}, {gap})"
        if name == "ntile":
            return f"ntile({int(a[0].value)})"
        if name in ("lag", "lead"):
            step = int(a[1].value) if len(a) > 1 else 1
            if len(a) > 2:
                x, other = self._alike([a[0], a[2]], s)
                return f"{name}({x}, {max(0, step)}, {other})"
            return f"{name}({self.value(a[0], s)}, {max(0, step)})"
        if name in ("row_number", "rank", "dense_rank"):
            return f"{name}()"
        if name in ("first_value", "last_value"):
            return f"{name}({self.value(a[0], s)})"
        raise DialectError(f"no such window function: {name}")

    # queries
    def _table(self, name: str) -> tuple[str, dict[str, str]]:
        for level in reversed(self.ctes):
            if name.lower() in level:
                return quoted(name), level[name.lower()]
        return self.lookup(name)

    def _scope(self, core: dict, outer: Scope | None) -> tuple[str, Scope]:
        scope, out = Scope(outer), ""
        for join, (source, alias), on in core["from"]:
            if isinstance(source, dict):
                name = alias or f"_d{len(scope.sources)}"
                scope.add(name, self.shape(source, None))
                text = f"({self.query(source, None)}) AS {quoted(name)}"
            else:
                spark_name, columns = self._table(source)
                name = alias or source
                scope.add(name, columns)
                text = f"{spark_name} AS {quoted(name)}"
            out += f" CROSS JOIN {text}" if join == "," else f" {join} JOIN {text}" if join else f" FROM {text}"
            if isinstance(on, list):
                out += " USING (" + ", ".join(map(quoted, on)) + ")"
            elif on is not None:
                out += " ON " + self.test(on, scope)
        return out, scope

    def _named(self, items: list, scope: Scope) -> list[tuple[str, Node]]:
        """The output columns of a select list, stars expanded."""
        out: list[tuple[str, Node]] = []
        for node, alias in items:
            if node.kind == "star":
                for source, columns in scope.sources.items():
                    if node.value is None or node.value.lower() == source:
                        out += [(c, Node("column", (source, c))) for c in columns if c != "rowid"]
            else:
                name = alias or (node.value[1] if node.kind == "column" else node.value if node.kind == "call" else f"column{len(out) + 1}")
                out.append((name, node))
        return out

    def _with(self, q: dict) -> None:
        level: dict[str, dict[str, str]] = {}
        self.ctes.append(level)
        for name, columns, inner in q["ctes"]:
            first = {**inner, "cores": inner["cores"][:1], "sets": [], "order": []} if q["recursive"] else inner
            found = self.shape(first, None)
            level[name.lower()] = dict(zip(columns, found.values(), strict=True)) if columns else found

    def shape(self, q: dict, outer: Scope | None) -> dict[str, str]:
        """Names and types of a query's columns."""
        self._with(q)
        try:
            core = q["cores"][0]
            if "values" in core:
                rows = core["values"]
                return {f"column{i + 1}": self._common([r[i] for r in rows], Scope()) for i in range(len(rows[0]))}
            _, scope = self._scope(core, outer)
            return {name: self._plain(self.kind(node, scope)) for name, node in self._named(core["items"], scope)}
        finally:
            self.ctes.pop()

    @staticmethod
    def _plain(kind: str) -> str:
        return {BOOL: INT, NULL: TEXT}.get(kind, kind)

    def query(self, q: dict, outer: Scope | None, first_row: bool = False) -> str:
        self._with(q)
        try:
            heads = []
            for name, columns, inner in q["ctes"]:
                heads.append(f"{quoted(name)}{'(' + ', '.join(map(quoted, columns)) + ')' if columns else ''} AS ({self.query(inner, None)})")
            out = f"WITH {'RECURSIVE ' if q['recursive'] else ''}{', '.join(heads)} " if heads else ""
            texts, last = [], None
            for core in q["cores"]:
                text, last = self._core(core, outer)
                texts.append(text)
            order = q["order"]
            if order and len(texts) == 1 and "values" not in q["cores"][0]:
                texts[0], order = self._sortable(q["cores"][0], outer, texts[0], last[0], order)
            out += texts[0] + "".join(f" {sign} {text}" for sign, text in zip(q["sets"], texts[1:], strict=True))
            if order:
                scope, names = last
                by = []
                for node, way in order:
                    if isinstance(node, str):
                        by.append(f"{node} {way}")
                    elif node.kind == "number" and node.value.isdigit():
                        by.append(f"{node.value} {way}")
                    elif node.kind == "column" and node.value[0] is None and node.value[1].lower() in names:
                        by.append(f"{quoted(node.value[1])} {way}")
                    else:
                        by.append(f"{self.value(node, scope)} {way}")
                out += " ORDER BY " + ", ".join(by)
            limit = q["limit"] if q["limit"] is not None and q["limit"] >= 0 else None
            if limit is None and first_row and not self._single(q):
                limit = 1
            if limit is not None:
                out += f" LIMIT {limit}"
            if q["offset"]:
                out += f" OFFSET {max(0, q['offset'])}"
            return out
        finally:
            self.ctes.pop()

    def _sortable(self, core: dict, outer: Scope | None, text: str, scope: Scope, order: list) -> tuple[str, list]:
        """Compute what a sort cannot, a call of a dialect function, in a column of its own below the sort."""
        named = self._named(core["items"], scope)
        by_name = {name.lower(): node for name, node in named}
        hidden, out = [], []
        for node, way in order:
            plain = node.kind == "number" or (node.kind == "column" and node.value[0] is None and node.value[1].lower() in by_name)
            whole = node if plain else self._unalias(node, by_name, scope)
            if not plain and re.search(r"\bt_\w+\(", self.value(whole, scope)):
                hidden.append((whole, f"_by{len(hidden)}"))
                out.append((quoted(hidden[-1][1]), way))
            else:
                out.append((node, way))
        if not hidden or core["distinct"]:
            return text, order
        shown = [quoted(name) for name, _ in named]
        # the other keys are computed below the sort too, as the inner columns are out of its sight
        for i, (node, way) in enumerate(out):
            if isinstance(node, Node) and node.kind == "number" and node.value.isdigit():
                out[i] = (shown[int(node.value) - 1], way)
            elif isinstance(node, Node) and not (node.kind == "column" and node.value[0] is None and node.value[1].lower() in by_name):
                hidden.append((self._unalias(node, by_name, scope), f"_by{len(hidden)}"))
                out[i] = (quoted(hidden[-1][1]), way)
        text, _ = self._core({**core, "items": [*core["items"], *hidden]}, outer)
        return f"SELECT {', '.join(shown)} FROM ({text})", out

    def _single(self, q: dict) -> bool:
        """Whether a query gives one row whatever the data: an aggregate without groups."""
        core = q["cores"][0]
        return not q["sets"] and not core["group"] and ("values" in core or not core["from"] or any(self._has_aggregate(n) for n, _ in core["items"]))

    def _has_aggregate(self, n: Any) -> bool:
        if not isinstance(n, Node):
            return any(map(self._has_aggregate, n)) if isinstance(n, list | tuple) else False
        if n.kind == "call" and n.value in _AGGREGATES and not n.extra.get("over") and (len(n.args) < 2 or n.value == "group_concat"):
            return True
        return n.kind not in ("scalar", "exists") and (any(map(self._has_aggregate, n.args)) or (isinstance(n.value, Node) and self._has_aggregate(n.value)))

    def _core(self, core: dict, outer: Scope | None) -> tuple[str, tuple[Scope, set[str]]]:
        if "values" in core:
            rows = core["values"]
            s = Scope()
            kinds = [self._common([r[i] for r in rows], s) for i in range(len(rows[0]))]
            return "SELECT * FROM VALUES " + ", ".join("(" + ", ".join(self._as(x, k, s) for x, k in zip(r, kinds, strict=True)) + ")" for r in rows) + f" AS t({', '.join(f'column{i + 1}' for i in range(len(kinds)))})", (s, set())
        source, scope = self._scope(core, outer)
        named = self._named(core["items"], scope)
        group = [self.value(named[int(g.value) - 1][1], scope) if g.kind == "number" and g.value.isdigit() else self.value(self._behind(g, named, scope), scope) for g in core["group"]]
        grouped = bool(group) or any(self._has_aggregate(n) for _, n in named) or (core["having"] is not None)
        items = []
        for name, node in named:
            shown = self._grouped(node, scope, group) if grouped else node
            out = self.value(shown, scope)
            if self.kind(node, scope) == NULL:
                out = "CAST(NULL AS STRING)"
            items.append(f"{out} AS {quoted(name)}")
        text = f"SELECT {'DISTINCT ' if core['distinct'] else ''}{', '.join(items)}{source}"
        if core["where"] is not None:
            text += " WHERE " + self.test(core["where"], scope)
        if group:
            text += " GROUP BY " + ", ".join(group)
        if core["having"] is not None:
            by_name = {name.lower(): node for name, node in named}
            text += " HAVING " + self.test(self._unalias(core["having"], by_name, scope), scope)
        return text, (scope, {name.lower() for name, _ in named})

    def _behind(self, n: Node, named: list[tuple[str, Node]], scope: Scope) -> Node:
        """What an alias in GROUP BY stands for."""
        if n.kind == "column" and n.value[0] is None and not scope.holds(n.value[1]):
            return next((node for name, node in named if name.lower() == n.value[1].lower()), n)
        return n

    def _unalias(self, n: Any, by_name: dict[str, Node], scope: Scope) -> Any:
        if isinstance(n, tuple):
            return tuple(self._unalias(x, by_name, scope) for x in n)
        if not isinstance(n, Node) or n.kind in ("scalar", "exists"):
            return n
        if n.kind == "column" and n.value[0] is None and not scope.holds(n.value[1]):
            return by_name.get(n.value[1].lower(), n)
        return Node(n.kind, self._unalias(n.value, by_name, scope) if isinstance(n.value, Node) else n.value, [self._unalias(x, by_name, scope) for x in n.args], n.extra)

    def _grouped(self, n: Any, scope: Scope, group: list[str]) -> Any:
        """Bare columns of grouped queries take the value of one row of the group."""
        if isinstance(n, tuple):
            return tuple(self._grouped(x, scope, group) for x in n)
        if not isinstance(n, Node) or n.kind in ("scalar", "exists", "number", "text", "null"):
            return n
        if self.value(n, scope) in group or (n.kind == "call" and n.value in _AGGREGATES and (len(n.args) < 2 or n.value == "group_concat")) or n.extra.get("over"):
            return n
        if n.kind == "column":
            bare = {g.split(".")[-1].lower() for g in group}
            return n if quoted(n.value[1]).lower() in bare else Node("first", None, [n])
        return Node(n.kind, self._grouped(n.value, scope, group) if isinstance(n.value, Node) else n.value, [self._grouped(x, scope, group) for x in n.args], n.extra)
