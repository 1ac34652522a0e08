"""Condition lists of structured queries as column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The operators of the condition language.
OPERATORS = ("eq", "ne", "req", "nreq", "contains", "ncontains", "existed", "nexisted", "exact", "gt", "gte", "lt", "lte")


@dataclass
class Condition:
    """One field condition. ``wildcard``, ``prefix`` and ``suffix`` change how contains and eq match; ``nested`` names an array of structs."""

    name: str
    op: str
    values: list[Any] = field(default_factory=list)
    wildcard: bool = False
    prefix: bool = False
    suffix: bool = False
    nested: str | None = None

    @classmethod
    def of(cls, raw: dict) -> Condition:
        op = str(raw.get("op", "eq")).lower()
        if op not in OPERATORS:
            raise ValueError(f"no operator: {op!r}")
        return cls(raw["field_name"], op, list(raw.get("value", [])), bool(raw.get("is_wildcard")), bool(raw.get("is_prefix")), bool(raw.get("is_suffix")), raw.get("nested"))


def dnf(fields: list[Condition], connectors: list[str]) -> list[list[Condition]]:
    """Flat lists to OR of ANDs; 'and' binds tighter. A condition without values is dropped, unless it asks for existence."""
    if len(connectors) != max(len(fields) - 1, 0):
        raise ValueError(f"{len(fields)} conditions need {max(len(fields) - 1, 0)} connectors, not {len(connectors)}")
    groups: list[list[Condition]] = [[]]
    for i, c in enumerate(fields):
        if i and connectors[i - 1].lower() == "or":
            groups.append([])
        if c.values or c.op in ("existed", "nexisted"):
            groups[-1].append(c)
    return [g for g in groups if g]


def dnf_and(a: list[list[Condition]], b: list[list[Condition]]) -> list[list[Condition]]:
    """Both at once: the cross product of the groups; an empty side restricts nothing."""
    return [x + y for x in a for y in b] if a and b else a or b


def like_pattern(text: str, prefix: bool = False, suffix: bool = False, wildcard: bool = False) -> str:
    """A LIKE pattern; with ``wildcard``, * and ? are the wildcards (a backslash takes their meaning away), else they are letters."""
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if wildcard and c == "\\" and i + 1 < len(text):
            i += 1
            c = text[i]
            out.append("\\" + c if c in "%_\\" else c)
        elif wildcard and c in "*?":
            out.append("%" if c == "*" else "_")
        else:
            out.append("\\" + c if c in "%_\\" else c)
        i += 1
    body = "".join(out)
    if prefix:
        return body + "%"
    return "%" + body if suffix else body


def whole_regex(pattern: str) -> str:
    """A regular expression that must match the whole value."""
    return f"^(?:{java_regex(pattern)})$"


def java_regex(pattern: str) -> str:
    """Named groups as plain ones: Java takes no underscore in names."""
    return re.sub(r"\(\?P?<[A-Za-z]\w*>", "(", pattern)


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)


def _one(c: Column, cond: Condition, kind: T.DataType | None, null_as_empty: bool) -> Column:
    op, values = cond.op, cond.values
    if isinstance(kind, T.ArrayType):
        element = Condition(cond.name, {"ne": "eq", "ncontains": "contains", "nreq": "req"}.get(op, op), values, cond.wildcard, cond.prefix, cond.suffix)
        if op in ("existed", "nexisted"):
            return F.size(c) > 0 if op == "existed" else c.isNull() | (F.size(c) == 0)
        hit = F.exists(c, lambda x: _one(x, element, kind.elementType, False))
        return ~hit if op in ("ne", "ncontains", "nreq") else hit
    if op == "existed":
        return c.isNotNull()
    if op == "nexisted":
        return c.isNull()
    if op in ("gt", "gte", "lt", "lte"):
        if len(values) != 1:
            raise ValueError(f"{op} takes one value, not {len(values)}")
        v = F.lit(values[0])
        return {"gt": c > v, "gte": c >= v, "lt": c < v, "lte": c <= v}[op]
    negative = op in ("ne", "nreq", "ncontains")
    if op in ("req", "nreq"):
        hit = c.cast("string").rlike(java_regex("|".join(str(v) for v in values)))
    elif cond.wildcard or cond.prefix or cond.suffix:
        hit = _any([c.cast("string").like(like_pattern(str(v), cond.prefix, cond.suffix, cond.wildcard)) for v in values])
    elif op in ("contains", "ncontains") and isinstance(kind, T.StringType):
        hit = _any([F.contains(c, F.lit(str(v))) for v in values])
    else:
        if null_as_empty and any(v == "" for v in values):
            rest = [v for v in values if v != ""]
            hit = c.isNull() | c.isin(rest) if rest else c.isNull()
        else:
            hit = c.isin(values) if len(values) > 1 else c == F.lit(values[0])
    return ~hit if negative else hit


def compile_dnf(df: DataFrame, groups: list[list[Condition]], null_semantics: str = "sql", null_as_empty: bool = False) -> Column:
    """OR of ANDs over ``df``. Several values of a positive operator are alternatives, of a negative one all are excluded. ``null_semantics``: with 'sql' a
    negative condition drops rows whose field is null, with 'search' it keeps them. ``null_as_empty``: '' stands for null. A field that
    ``df`` lacks is null. No conditions: true."""

    def column(c: Condition) -> Column:
        kind, col = field_of(df, c.name)
        if c.nested:
            outer, array = field_of(df, c.nested)
            inner = c.name.removeprefix(c.nested + ".")
            plain = Condition(inner, {"ne": "eq", "ncontains": "contains", "nreq": "req"}.get(c.op, c.op), c.values, c.wildcard, c.prefix, c.suffix)
            element = outer.elementType[inner].dataType
            hit = F.exists(array, lambda x: F.coalesce(_one(x[inner], plain, element, null_as_empty), F.lit(False)))
            return ~F.coalesce(hit, F.lit(False)) if c.op in ("ne", "ncontains", "nreq") else hit
        hit = _one(col, c, kind, null_as_empty)
        if null_semantics == "search" and c.op in ("ne", "nreq", "ncontains"):
            hit = hit | col.isNull()
        return hit

    if not groups:
        return F.lit(True)
    return _any([reduce(lambda a, b: a & b, [column(c) for c in g]) for g in groups])


def field_of(df: DataFrame, name: str) -> tuple[T.DataType | None, Column]:
    """Type and column of a field, dotted paths included; case doesn't matter; null where the table lacks it."""
    kind: T.DataType = df.schema
    col: Column | None = None
    rest = name.split(".")
    while rest:
        if isinstance(kind, T.MapType):
            key = ".".join(rest)
            return kind.valueType, F.try_element_at(col, F.lit(key))
        if not isinstance(kind, T.StructType):
            return None, F.lit(None)
        found = next((f for n in range(len(rest), 0, -1) for f in kind.fields if f.name.lower() == ".".join(rest[:n]).lower()), None)
        if found is None:
            return None, F.lit(None)
        col = F.col(f"`{found.name}`") if col is None else col[found.name]
        kind, rest = found.dataType, rest[found.name.count(".") + 1 :]
    return kind, col


def factored(groups: list[list[Condition]]) -> tuple[list[Condition], list[list[Condition]]]:
    """The conditions that all groups share, and what is left of each group."""
    if len(groups) < 2:
        return (groups[0] if groups else []), []
    shared = [c for c in groups[0] if all(c in g for g in groups[1:])]
    return shared, [[c for c in g if c not in shared] for g in groups]


def phrase(c: Column, text: str, prefix: bool = False, edge: bool = False) -> Column:
    """The phrase's words, one after the other, in an analysed text: whole words, in any case, separators don't matter. ``prefix``: the last word may go on;
    ``edge``: the phrase may lie inside words at both ends."""
    tokens = re.findall(r"\w+", text.lower())
    if not tokens:
        return F.lit(False)
    body = r"\W+".join(re.escape(t) for t in tokens)
    head = "" if edge else r"(?:^|\W)"
    tail = "" if edge or prefix else r"(?:\W|$)"
    return F.lower(c).rlike(f"{head}{body}{tail}")


def matcher(labels: Column, name: str, op: str, value: str) -> Column:
    """A label matcher of a time-series selector: a missing label is '', expressions must match as a whole."""
    v = F.coalesce(F.try_element_at(labels, F.lit(name)), F.lit(""))
    if op in ("=", "!="):
        return v == value if op == "=" else v != value
    if op in ("=~", "!~"):
        return v.rlike(whole_regex(value)) if op == "=~" else ~v.rlike(whole_regex(value))
    raise ValueError(f"no matcher: {op!r}")


def as_matcher(c: Condition) -> tuple[str, str, str]:
    """A condition as a label matcher; several values become alternatives."""
    single = len(c.values) == 1
    positive = c.op in ("eq", "contains", "exact", "req")
    if c.op not in ("eq", "contains", "exact", "req", "ne", "ncontains", "nreq"):
        raise ValueError(f"{c.op} is no label matcher")
    if c.op in ("req", "nreq"):
        return c.name, "=~" if positive else "!~", "|".join(map(str, c.values))
    if single:
        return c.name, "=" if positive else "!=", str(c.values[0])
    return c.name, "=~" if positive else "!~", "^(" + "|".join(re.escape(str(v)) for v in c.values) + ")$"


def whole_term(c: Column, pattern: str) -> Column:
    """A search engine's regexp: it must match the whole term, so anchors at its ends say nothing new; a leading negative look-ahead, which such engines don't know, is a second condition that must not hold at the term's beginning."""
    body = re.sub(r"(?<!\\)\$$", "", pattern.removeprefix("^"))
    refused: list[str] = []
    while body.startswith("(?!"):
        depth, i, in_class = 0, 0, False
        while i < len(body):
            ch = body[i]
            if ch == "\\":
                i += 1
            elif in_class:
                in_class = ch != "]"
            elif ch == "[":
                in_class = True
            elif ch in "()":
                depth += 1 if ch == "(" else -1
                if not depth:
                    break
            i += 1
        if i >= len(body):
            raise ValueError(f"a bracket isn't closed: {pattern!r}")
        refused.append(body[3:i])
        body = body[i + 1 :]
    hit = c.rlike(f"(?s)^(?:{body})$")
    return reduce(lambda a, r: a & ~c.rlike(f"(?s)^(?:{r})"), refused, hit)
