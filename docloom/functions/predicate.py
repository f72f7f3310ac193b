"""The row predicate: a small three-valued language, parsed here and compiled to DataFrame expressions.

``column op literal`` joined by AND, OR, NOT and parentheses; ops ``= <> != < <= > >=``, ``IS [NOT] NULL``,
``[NOT] IN (...)``. The column stands on the left. Only rows for which it is TRUE are kept.

The text is never handed to Spark's SQL parser, which accepts much more and compares by other rules: text
compares with text byte by byte and with numbers by value (text that is no number is UNKNOWN, as are
number with text and bool with anything else). Catalyst pushes the resulting columns down to scans.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Literal = str | int | float | bool


class PredicateError(ValueError):
    """A predicate outside the language."""


@dataclass(frozen=True)
class Compare:
    column: str
    op: str
    literal: Literal


@dataclass(frozen=True)
class IsNull:
    column: str
    negated: bool


@dataclass(frozen=True)
class In:
    column: str
    literals: tuple[Literal, ...]
    negated: bool


@dataclass(frozen=True)
class Junction:
    kind: str  # AND or OR
    terms: tuple[Node, ...]


@dataclass(frozen=True)
class Not:
    term: Node


Node = Compare | IsNull | In | Junction | Not

TOKENS = re.compile(
    r"""\s*(?:(?P<number>[+-]?(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?)
    |(?P<text>'(?:[^']|'')*')|(?P<quoted>"(?:[^"]|"")+"|`[^`]+`)
    |(?P<word>[A-Za-z_][A-Za-z0-9_$]*)|(?P<op><>|!=|<=|>=|=|<|>)|(?P<mark>[(),]))""",
    re.VERBOSE,
)
REFUSED = {"LIKE", "ILIKE", "BETWEEN", "EXISTS", "CASE", "SELECT", "ANY", "ALL", "SIMILAR"}
KEYWORDS = {"AND", "OR", "NOT", "IS", "NULL", "IN", "TRUE", "FALSE"} | REFUSED


class _Parser:
    def __init__(self, text: str) -> None:
        self.tokens: list[tuple[str, str]] = []
        at, end = 0, len(text.rstrip())
        while at < end:
            m = TOKENS.match(text, at)
            if not m:
                raise PredicateError(f"unexpected {text[at:].strip()[:12]!r}")
            kind = m.lastgroup or ""
            value = m[kind]
            if kind == "word" and value.upper() in KEYWORDS:
                kind, value = "key", value.upper()
            self.tokens.append((kind, value))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, *wanted: str) -> str | None:
        kind, value = self.peek()
        if value in wanted and kind in ("key", "mark", "op"):
            self.at += 1
            return value
        return None

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise PredicateError(f"expected {wanted}, found {self.peek()[1] or 'the end'!r}")

    def either(self) -> Node:
        return self.chain("OR", lambda: self.chain("AND", self.negation))

    def chain(self, kind: str, part: Callable[[], Node]) -> Node:
        terms = [part()]
        while self.take(kind):
            terms.append(part())
        return terms[0] if len(terms) == 1 else Junction(kind, tuple(terms))

    def negation(self) -> Node:
        return Not(self.negation()) if self.take("NOT") else self.primary()

    def primary(self) -> Node:
        if self.take("("):
            inner = self.either()
            self.need(")")
            return inner
        kind, value = self.peek()
        if kind not in ("word", "quoted"):
            raise PredicateError(f"a comparison begins with a column, found {value or 'the end'!r}")
        self.at += 1
        column = value if kind == "word" else value[1:-1].replace('""', '"')
        if self.peek() == ("mark", "("):
            raise PredicateError(f"functions are not part of the language: {column}")
        if self.take("IS"):
            negated = bool(self.take("NOT"))
            self.need("NULL")
            return IsNull(column, negated)
        negated = bool(self.take("NOT"))
        if self.take("IN"):
            self.need("(")
            literals = [self.literal()]
            while self.take(","):
                literals.append(self.literal())
            self.need(")")
            return In(column, tuple(literals), negated)
        kind, value = self.peek()
        if value in REFUSED:
            raise PredicateError(f"{value} is not part of the language")
        if negated or kind != "op":
            raise PredicateError(f"expected a comparison after {column}, found {value or 'the end'!r}")
        self.at += 1
        return Compare(column, "<>" if value == "!=" else value, self.literal())

    def literal(self) -> Literal:
        kind, value = self.peek()
        self.at += 1
        if kind == "text":
            return value[1:-1].replace("''", "'")
        if kind == "number":
            if re.fullmatch(r"[+-]?\d+", value) and -(2**63) <= int(value) < 2**63:
                return int(value)
            return float(value)
        if kind == "key" and value in ("TRUE", "FALSE"):
            return value == "TRUE"
        if kind == "key" and value == "NULL":
            raise PredicateError("comparing with NULL is never true; use IS NULL")
        raise PredicateError(f"expected a literal, found {value or 'the end'!r}")


class Predicate:
    """A parsed predicate: its columns, its SQL text and its Spark column."""

    def __init__(self, text: str) -> None:
        parser = _Parser(text)
        self.root = parser.either()
        if parser.peek()[0] != "end":
            raise PredicateError(f"unexpected {parser.peek()[1]!r}")

    @property
    def columns(self) -> list[str]:
        found: set[str] = set()

        def walk(node: Node) -> None:
            if isinstance(node, Junction):
                for t in node.terms:
                    walk(t)
            elif isinstance(node, Not):
                walk(node.term)
            else:
                found.add(node.column)

        walk(self.root)
        return sorted(found)

    def check(self, schema: T.StructType) -> None:
        missing = [c for c in self.columns if c not in schema.names]
        if missing:
            raise PredicateError(f"no such columns: {', '.join(missing)}")

    def column(self, schema: T.StructType, prefix: str = "") -> Column:
        """TRUE, FALSE or NULL (unknown) for each row of a DataFrame of this schema; an absent column is NULL."""
        return _compiled(self.root, schema, prefix)

    def keeps(self, schema: T.StructType, prefix: str = "") -> Column:
        return F.coalesce(self.column(schema, prefix), F.lit(False))

    def sql(self, quote: str = '"') -> str:
        return _rendered(self.root, quote)


def _compiled(node: Node, schema: T.StructType, prefix: str) -> Column:
    if isinstance(node, Junction):
        terms = [_compiled(t, schema, prefix) for t in node.terms]
        out = terms[0]
        for t in terms[1:]:
            out = out & t if node.kind == "AND" else out | t
        return out
    if isinstance(node, Not):
        return ~_compiled(node.term, schema, prefix)
    if node.column not in schema.names:
        return F.lit(node.negated is False) if isinstance(node, IsNull) else F.lit(None).cast("boolean")
    value, kind = F.col(f"{prefix}`{node.column}`"), schema[node.column].dataType
    if isinstance(node, IsNull):
        return value.isNotNull() if node.negated else value.isNull()
    if isinstance(node, Compare):
        return _compared(value, kind, node.op, node.literal)
    hits = [_compared(value, kind, "=", x) for x in node.literals]
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return ~out if node.negated else out


NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _compared(value: Column, kind: T.DataType, op: str, literal: Literal) -> Column:
    ops: dict[str, Callable[[Column, Column], Column]] = {
        "=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b,
        "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
    }
    compare, unknown = ops[op], F.lit(None).cast("boolean")
    texty = not isinstance(kind, (T.NumericType, T.BooleanType)) or isinstance(kind, T.DecimalType)
    if isinstance(literal, bool):
        return compare(value, F.lit(literal)) if isinstance(kind, T.BooleanType) else unknown
    if isinstance(literal, str):
        if isinstance(kind, (T.NumericType, T.BooleanType)):
            return unknown
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            value = F.date_format(value, "yyyy-MM-dd HH:mm:ss")
        return compare(value.cast("string"), F.lit(literal))
    if isinstance(kind, T.BooleanType):
        return unknown
    if not texty:
        return compare(value, F.lit(literal))
    if isinstance(kind, T.DecimalType):
        return compare(value, F.lit(literal))
    text = value.cast("string")
    as_double = F.when(text.rlike(NUMBER), text.try_cast("double"))
    if isinstance(literal, float):
        return compare(as_double, F.lit(literal))
    # integers of any length stay exact; other numbers compare as doubles
    whole = F.when(text.rlike(r"^[+-]?[0-9]{1,38}$"), text.try_cast("decimal(38,0)"))
    return F.when(whole.isNotNull(), compare(whole, F.lit(literal).cast("decimal(38,0)"))).otherwise(compare(as_double, F.lit(float(literal))))


def _rendered(node: Node, quote: str) -> str:
    def text(x: Literal) -> str:
        if isinstance(x, bool):
            return str(x).upper()
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)

    if isinstance(node, Junction):
        return "(" + f" {node.kind} ".join(_rendered(t, quote) for t in node.terms) + ")"
    if isinstance(node, Not):
        return f"(NOT {_rendered(node.term, quote)})"
    name = quote + node.column.replace(quote, quote * 2) + quote
    if isinstance(node, IsNull):
        return f"({name} IS {'NOT ' * node.negated}NULL)"
    if isinstance(node, In):
        return f"({name} {'NOT ' * node.negated}IN ({', '.join(map(text, node.literals))}))"
    return f"({name} {node.op} {text(node.literal)})"
