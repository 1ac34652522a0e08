"""Raw queries planned together: those that ask the same of several tables are one batch, and each table is read once."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.catalog import Catalog
from tidegauge.operators.conditions import compile_dnf
from tidegauge.operators.merge import union_all
from tidegauge.plans import lucene
from tidegauge.plans.structured import Query


@dataclass
class Batch:
    """Queries (by their places in the request) with one body, and the tables it is asked of."""

    body: Query
    members: list[int]
    tables: list[str]


def fingerprint(q: Query) -> str:
    """Equal for queries that differ in nothing but the table and the reference."""
    body = asdict(q)
    for k in ("table", "reference"):
        body.pop(k)
    return json.dumps(body, sort_keys=True, default=str)


def eligible(q: Query) -> bool:
    """Raw rows from their beginning; aggregates, and pages further on, have states of their own per table."""
    return not q.functions and not q.time_aggregation and not q.offset


def planned(queries: list[Query]) -> tuple[list[Batch], list[int]]:
    """Batches of equal bodies, in order of their first query, and the places of the queries that stay alone."""
    batches: dict[str, Batch] = {}
    alone = []
    for i, q in enumerate(queries):
        if not eligible(q):
            alone.append(i)
            continue
        b = batches.setdefault(fingerprint(q), Batch(q, [], []))
        b.members.append(i)
        if q.table not in b.tables:
            b.tables.append(q.table)
    return list(batches.values()), alone


def run_batches(catalog: Catalog, queries: list[Query], start: int, end: int) -> DataFrame:
    """Rows of all eligible queries, each with ``__query`` (its place) and ``__table``. A table is scanned once: every row is tested for all bodies that are asked of it in the same pass, and comes out once per query it answers."""
    batches, _ = planned(queries)
    if not batches:
        raise ValueError("no query can be batched")
    parts = []
    for name in dict.fromkeys(t for b in batches for t in b.tables):
        df = catalog.scan(name, start, end)
        hits = []
        for b in batches:
            mine = [i for i in b.members if queries[i].table == name]
            if mine:
                hit = compile_dnf(df, b.body.groups, "sql")
                if b.body.query_string:
                    hit = hit & lucene.compile_query(df, b.body.query_string)
                hits.append(F.when(hit, F.array(*map(F.lit, mine))))
        keep = list(dict.fromkeys(c for b in batches if name in b.tables for c in (b.body.keep or df.columns)))
        answered = F.flatten(F.array_compact(F.array(*hits)))
        parts.append(df.select(*keep, F.explode(answered).alias("__query"), F.lit(name).alias("__table")))
    columns = list(dict.fromkeys(c for p in parts for c in p.columns))
    return parts[0] if len(parts) == 1 else union_all(parts, columns)
