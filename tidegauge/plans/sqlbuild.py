"""Structured queries as SQL texts of the dialects that SQL storages speak."""

from __future__ import annotations

from dataclasses import dataclass

from tidegauge.operators.conditions import Condition, like_pattern
from tidegauge.plans.structured import Query


@dataclass(frozen=True)
class Form:
    """What a dialect writes otherwise: whether buckets are cast, whether GROUP BY repeats expressions instead of naming them, and whether a list of one value is compared with = ."""

    cast_bucket: bool = True
    group_by_name: bool = True
    single_equals: bool = True


FORMS = {"doris": Form(), "tspider": Form(cast_bucket=False, group_by_name=False)}


def quoted(value: object) -> str:
    if isinstance(value, bool) or value is None:
        return {True: "TRUE", False: "FALSE", None: "NULL"}[value]
    return str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("\\", "\\\\").replace("'", "''") + "'"


def _name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def condition(c: Condition) -> str:
    n, op, values = _name(c.name), c.op, c.values
    if op in ("existed", "nexisted"):
        return f"{n} IS {'NOT ' if op == 'existed' else ''}NULL"
    if op in ("gt", "gte", "lt", "lte"):
        if len(values) != 1:
            raise ValueError(f"{op} takes one value, not {len(values)}")
        return f"{n} { {'gt': '>', 'gte': '>=', 'lt': '<', 'lte': '<='}[op] } {quoted(values[0])}"
    negative = op in ("ne", "nreq", "ncontains")
    if op in ("req", "nreq"):
        return f"{n} {'NOT ' if negative else ''}REGEXP {quoted('|'.join(map(str, values)))}"
    if op in ("contains", "ncontains") or c.wildcard or c.prefix or c.suffix:
        whole = c.wildcard or c.prefix or c.suffix
        likes = [f"{n} LIKE {quoted(like_pattern(str(v), c.prefix, c.suffix, c.wildcard) if whole else '%' + str(v) + '%')}" for v in values]
        both = " OR ".join(likes) if len(likes) == 1 else "(" + " OR ".join(likes) + ")"
        return f"NOT {both}" if negative else both
    rest = [v for v in values if v != ""]
    parts = ([f"{n} IS NULL"] if len(rest) < len(values) else []) + ([f"{n} = {quoted(rest[0])}"] if len(rest) == 1 else [f"{n} IN ({', '.join(map(quoted, rest))})"] if rest else [])
    if not negative:
        return parts[0] if len(parts) == 1 else "(" + " OR ".join(parts) + ")"
    turned = [p.replace(" IS NULL", " IS NOT NULL").replace(" = ", " != ", 1).replace(" IN (", " NOT IN (", 1) for p in parts]
    return " AND ".join(turned)


def order_keys(keys: list[str], dims: list[str]) -> list[str]:
    """Keys an aggregate can be sorted by (dimensions, _value, _time), each once; others are left out. They keep the request's order."""
    out: list[str] = []
    seen: set[str] = set()
    for k in keys:
        name = k.lstrip("-")
        column = {"_value": "_value_", "_time": "_timestamp_"}.get(name, name)
        if column not in seen and (name in dims or name in ("_value", "_time")):
            seen.add(column)
            out.append(f"{_name(column)} {'DESC' if k.startswith('-') else 'ASC'}")
    return out


def build(q: Query, table: str, time_ms: str, start: int, end: int, dialect: str = "doris", order: list[str] | None = None, offset_ms: int = 0, closed: bool = False) -> str:
    """One statement: dimensions, ``_value_`` by the query's function over its value, and ``_timestamp_`` per window if the function has one; raw rows without a function. Times in ms are those of ``time_ms``,
    [start, end) or [start, end] if ``closed``; ``offset_ms`` moves the borders of windows (the zone)."""
    from tidegauge.functions.timeutil import duration_ms

    form = FORMS[dialect]
    groups = [" AND ".join(condition(c) for c in g) for g in q.groups]
    where = [f"{_name(time_ms)} >= {start}", f"{_name(time_ms)} {'<=' if closed else '<'} {end}"]
    if groups:
        where.append(groups[0] if len(groups) == 1 else "(" + " OR ".join(f"({g})" if " AND " in g else g for g in groups) + ")")
    limits = (f" LIMIT {q.limit}" if q.limit is not None else "") + (f" OFFSET {q.offset}" if q.offset else "")
    if not q.functions:
        columns = ", ".join(map(_name, q.keep)) or "*"
        keys = [f"{_name(k.lstrip('-'))} {'DESC' if k.startswith('-') else 'ASC'}" for k in order or q.order]
        return f"SELECT {columns} FROM {table} WHERE {' AND '.join(where)}" + (f" ORDER BY {', '.join(keys)}" if keys else "") + limits
    f = q.functions[0]
    dims = list(f.get("dimensions", []))
    value = "*" if q.value == "*" else _name(q.value)
    method = {"mean": "AVG", "cardinality": "COUNT(DISTINCT", "count": "COUNT"}.get(f["method"], f["method"].upper())
    made = f"{method} {value})" if method.endswith("DISTINCT") else f"{method}({value})"
    selected, grouped = [_name(d) for d in dims], [_name(d) for d in dims]
    if f.get("window"):
        w = duration_ms(f["window"])
        bucket = f"FLOOR(({_name(time_ms)} + {offset_ms}) / {w}) * {w} - {offset_ms}"
        if form.cast_bucket:
            bucket = f"CAST({bucket} AS BIGINT)"
        selected.append(f"{bucket} AS `_timestamp_`")
        grouped.append("`_timestamp_`" if form.group_by_name else bucket)
    keys = order_keys(order or q.order, dims)
    return (f"SELECT {', '.join([*selected, f'{made} AS `_value_`'])} FROM {table} WHERE {' AND '.join(where)}"
            + (f" GROUP BY {', '.join(grouped)}" if grouped else "") + (f" ORDER BY {', '.join(keys)}" if keys else "") + limits)
