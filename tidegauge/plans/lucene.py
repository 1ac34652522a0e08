"""Lucene-style query strings as column expressions.

Grammar: words, "phrases", field:term, field:(...), field:[a TO b], field:{a TO b}, field:>n, /regex/, wildcards * and ?, boost ^n and fuzzy ~n (both read,
neither changes what matches exactly), + - NOT ! AND OR && || and brackets. Terms side by side are alternatives unless some are marked: then the ones
with + are needed, those with - excluded, and the free ones change nothing. Excluding keeps rows without a value."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.operators.conditions import field_of, java_regex, like_pattern, phrase, whole_term

DEFAULT_FIELD = "log"
_TOKEN = re.compile(
    r"""\s*(?:(?P<quoted>"(?:[^"\\]|\\.)*")|(?P<regex>/(?:[^/\\]|\\.)*/)|(?P<range>[\[{]\s*(?:"[^"]*"|[^\s\]}]+)\s+TO\s+(?:"[^"]*"|[^\s\]}]+)\s*[\]}])
    |(?P<mark>[+\-!](?=[^\s]))|(?P<bool>(?:AND|OR|NOT|&&|\|\|)(?=[\s(]|$))|(?P<open>\()|(?P<close>\))|(?P<colon>:)|(?P<compare>[<>]=?)|(?P<suffix>[~^][0-9.]*)
    |(?P<word>(?:[^\s()":\[\]{}<>~^\\]|\\.)+))""",
    re.X,
)


class LuceneError(ValueError):
    """A text that isn't a query string."""


@dataclass
class Term:
    """kind: word, phrase, regex, range, compare."""

    field: str | None
    kind: str
    value: str = ""
    low: str = "*"
    high: str = "*"
    closed: tuple[bool, bool] = (True, True)


@dataclass
class Logic:
    op: str
    parts: list = field(default_factory=list)


def normalise(text: str) -> str:
    """Usual slips put right: single quotes as double ones, operators in any case, operators left over at the ends."""
    t = re.sub(r"(?<![\w\\])'([^']*)'(?!\w)", r'"\1"', text.strip())
    pieces = re.split(r'("(?:[^"\\]|\\.)*")', t)
    pieces = [p if p.startswith('"') else re.sub(r"(?<=[\s)])(and|or|not)(?=[\s(])|^(not)(?=[\s(])", lambda m: m[0].upper(), p, flags=re.I) for p in pieces]
    t = "".join(pieces)
    t = re.sub(r"(?:\s+(?:AND|OR|NOT|&&|\|\|))+\s*$", "", t, flags=re.I)
    return re.sub(r"^\s*(?:(?:AND|OR|&&|\|\|)\s+)+", "", t, flags=re.I)


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.i, at = [], 0, 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m or m.end() == at:
                raise LuceneError(f"unexpected {text[at:at + 10]!r}")
            self.tokens.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        self.tokens.append(("end", ""))

    def kind(self) -> str:
        return self.tokens[self.i][0]

    def take(self) -> str:
        self.i += 1
        return self.tokens[self.i - 1][1]

    def disjunction(self, name: str | None):
        """Segments that OR separates; within a segment clauses stand side by side, and AND binds tighter."""
        segments: list[list[tuple[str, object]]] = [[]]
        while self.kind() not in ("end", "close"):
            if self.kind() == "bool" and self.tokens[self.i][1] in ("OR", "||"):
                self.take()
                segments.append([])
                continue
            g = self.conjunction(name)
            segments[-1].append(g[0] if len(g) == 1 else ("", Logic("and", [self.marked(c) for c in g])))
        made = [self.combined(x) for x in segments if x]
        if not made:
            raise LuceneError("an empty query")
        return made[0] if len(made) == 1 else Logic("or", [p for m in made for p in (m.parts if isinstance(m, Logic) and m.op == "or" else [m])])

    def conjunction(self, name: str | None) -> list[tuple[str, object]]:
        out = [self.clause(name)]
        while self.kind() == "bool" and self.tokens[self.i][1] in ("AND", "&&"):
            self.take()
            out.append(self.clause(name))
        return out

    @staticmethod
    def marked(c: tuple[str, object]):
        return Logic("not", [c[1]]) if c[0] == "-" else c[1]

    def combined(self, clauses: list[tuple[str, object]]):
        """Marked clauses decide, free ones beside them only rank; without any, free ones are alternatives."""
        must = [c for m, c in clauses if m == "+"] + [Logic("not", [c]) for m, c in clauses if m == "-"]
        if must:
            return must[0] if len(must) == 1 else Logic("and", must)
        free = [c for _, c in clauses]
        return free[0] if len(free) == 1 else Logic("or", free)

    def clause(self, name: str | None) -> tuple[str, object]:
        mark = ""
        while self.kind() == "mark" or (self.kind() == "bool" and self.tokens[self.i][1] == "NOT"):
            sign = self.take()
            mark = "+" if sign == "+" else ("" if mark == "-" else "-")
        return mark, self.atom(name)

    def atom(self, name: str | None):
        kind = self.kind()
        if kind == "open":
            self.take()
            inner = self.disjunction(name)
            if self.kind() != "close":
                raise LuceneError("a bracket isn't closed")
            self.take()
            self.suffix()
            return inner
        if kind == "word" and self.tokens[self.i + 1][0] == "colon":
            own = re.sub(r"\\(.)", r"\1", self.take())
            self.take()
            return self.atom(own)
        if kind == "compare":
            op = self.take()
            value = self.take()
            low, high = (value, "*") if op[0] == ">" else ("*", value)
            return Term(name, "range", low=low, high=high, closed=(op == ">=" or op[0] == "<", op == "<=" or op[0] == ">"))
        if kind == "range":
            text = self.take()
            low, high = re.fullmatch(r'[\[{]\s*("[^"]*"|\S+)\s+TO\s+("[^"]*"|[^\s\]}]+)\s*[\]}]', text).groups()
            return Term(name, "range", low=low.strip('"'), high=high.strip('"'), closed=(text[0] == "[", text[-1] == "]"))
        if kind in ("quoted", "regex", "word"):
            text = self.take()
            self.suffix()
            if kind == "word":
                return Term(name, "word", text)
            body = re.sub(r"\\(.)", r"\1", text[1:-1]) if kind == "quoted" else text[1:-1].replace("\\/", "/")
            return Term(name, "phrase" if kind == "quoted" else "regex", body)
        raise LuceneError(f"unexpected {self.tokens[self.i][1]!r}")

    def suffix(self) -> None:
        while self.kind() == "suffix":
            self.take()


def parse(text: str) -> Term | Logic:
    """The tree of a query string."""
    p = _Parser(normalise(text))
    tree = p.disjunction(None)
    if p.kind() != "end":
        raise LuceneError("a bracket too many")
    return tree


def _value(kind: T.DataType | None, text: str):
    text = re.sub(r"\\(.)", r"\1", text)
    if isinstance(kind, T.NumericType):
        return F.lit(text).try_cast(kind if not isinstance(kind, T.IntegralType) else "double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.lit(text).try_cast(kind)
    return F.lit(text)


def compile_query(df: DataFrame, text: str, default: str = DEFAULT_FIELD, analysed: tuple[str, ...] = (), insensitive: tuple[str, ...] = ()) -> Column:
    """The boolean column of a query string over ``df``. ``analysed`` fields match by words, others as a whole (or by wildcards); the default field is analysed. '*' as a field
    or an empty default searches all text columns. ``field:""`` asks that there is a value, ``_exists_:field`` too. An empty query matches all."""
    if not text.strip() or text.strip() == "*":
        return F.lit(True)
    by_words = {*analysed, default}

    def column(node) -> Column:
        if isinstance(node, Logic):
            parts = [F.coalesce(column(p), F.lit(False)) for p in node.parts]
            if node.op == "not":
                return ~parts[0]
            return reduce((lambda a, b: a | b) if node.op == "or" else (lambda a, b: a & b), parts)
        name = node.field if node.field is not None else default
        if name == "_exists_":
            return field_of(df, node.value)[1].isNotNull()
        if name in ("", "*"):
            texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
            return reduce(lambda a, b: a | b, [F.coalesce(column(Term(t, node.kind, node.value)), F.lit(False)) for t in texts], F.lit(False))
        kind, c = field_of(df, name)
        if isinstance(kind, T.ArrayType):
            return F.exists(c, lambda x: F.coalesce(term(node, name, kind.elementType, x), F.lit(False)))
        return term(node, name, kind, c)

    def term(node: Term, name: str, kind: T.DataType | None, c: Column) -> Column:
        if node.kind == "range":
            parts = []
            if node.low != "*":
                low = _value(kind, node.low)
                parts.append(c >= low if node.closed[0] else c > low)
            if node.high != "*":
                high = _value(kind, node.high)
                parts.append(c <= high if node.closed[1] else c < high)
            return reduce(lambda a, b: a & b, parts) if parts else c.isNotNull()
        if node.kind == "regex":
            return c.cast("string").rlike(java_regex(node.value))
        if node.kind == "phrase":
            if node.value == "":
                return c.isNotNull()
            if isinstance(kind, T.StringType) and name in by_words:
                return phrase(c, node.value)
            return same(name, c, kind, node.value)
        if node.value == "*":
            return c.isNotNull()
        if re.search(r"(?<!\\)[*?]", node.value):
            pattern = like_pattern(node.value, wildcard=True)
            whole = pattern if name not in by_words else f"%{pattern}%"
            return F.lower(c.cast("string")).like(whole.lower()) if name in by_words or name in insensitive else c.cast("string").like(whole)
        value = re.sub(r"\\(.)", r"\1", node.value)
        if isinstance(kind, T.StringType) and name in by_words:
            return phrase(c, value)
        return same(name, c, kind, value)

    def same(name: str, c: Column, kind: T.DataType | None, value: str) -> Column:
        if isinstance(kind, T.BooleanType):
            return c == F.lit(value.lower() == "true")
        if name in insensitive:
            return F.lower(c) == value.lower()
        return c == _value(kind, value)

    return column(parse(text))


def to_search(text: str, default: str = DEFAULT_FIELD) -> dict:
    """The tree as a search request body (bool, match_phrase, range, wildcard, regexp)."""

    def node(n) -> dict:
        if isinstance(n, Logic):
            parts = [node(p) for p in n.parts]
            return {"bool": {{"and": "must", "or": "should", "not": "must_not"}[n.op]: parts}}
        name = n.field if n.field is not None else default
        if name == "_exists_":
            return {"exists": {"field": n.value}}
        if n.kind == "range":
            body = {}
            if n.low != "*":
                body["gte" if n.closed[0] else "gt"] = n.low
            if n.high != "*":
                body["lte" if n.closed[1] else "lt"] = n.high
            return {"range": {name: body}}
        if n.kind == "regex":
            return {"regexp": {name: {"value": n.value}}}
        if n.kind == "word" and re.search(r"(?<!\\)[*?]", n.value):
            return {"exists": {"field": name}} if n.value == "*" else {"wildcard": {name: {"value": n.value}}}
        return {"match_phrase": {name: {"query": n.value}}}

    return node(parse(text))


def search_condition(df: DataFrame, body: dict) -> Column:
    """A search request body (bool, match_phrase, range, wildcard, regexp, exists) as a condition; null values match nothing, and no ``must_not`` refuses them."""
    (kind, inner), = body.items()
    known = lambda c: F.coalesce(c, F.lit(False))
    if kind == "bool":
        parts = [reduce(lambda a, b: a & b, [search_condition(df, x) for x in inner["must"]])] if inner.get("must") else []
        parts += [reduce(lambda a, b: a | b, [search_condition(df, x) for x in inner["should"]])] if inner.get("should") else []
        parts += [~search_condition(df, x) for x in inner.get("must_not", [])]
        return reduce(lambda a, b: a & b, parts, F.lit(True))
    if kind == "exists":
        return F.col(inner["field"]).isNotNull()
    (name, told), = inner.items()
    column = F.col(name)
    if kind == "range":
        data = {f.name: f.dataType for f in df.schema.fields}[name]
        ops = {"gt": lambda v: column > v, "gte": lambda v: column >= v, "lt": lambda v: column < v, "lte": lambda v: column <= v}
        return known(reduce(lambda a, b: a & b, [ops[k](F.lit(_value(data, v))) for k, v in told.items()], column.isNotNull()))
    if kind == "wildcard":
        return known(column.cast("string").like(like_pattern(told["value"], wildcard=True)))
    if kind == "regexp":
        return known(whole_term(column.cast("string"), told["value"]))
    return known(phrase(column.cast("string"), told["query"]))
