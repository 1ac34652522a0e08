"""Line-based inputs: Influx line protocol, text exposition, polled HTTP events."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def influx_lines(df: DataFrame, line: str = "value") -> DataFrame:
    """``measurement, tags, fields, time_ns`` of line protocol; escaped commas, spaces and equal signs belong to names and values, quoted texts lose their quotes."""
    c = F.col(line)
    shape = r'^((?:[^,\s\\]|\\.)+)((?:,(?:[^\s\\]|\\.)+)?)\s+((?:[^\s"\\]|\\.|"(?:[^"\\]|\\.)*")+)(?:\s+(-?\d+))?\s*$'
    rows = df.where(c.rlike(shape) & ~c.startswith("#"))
    plain = lambda x: F.regexp_replace(x, r"\\([,=\s])", "$1")
    pairs = lambda text, pattern: F.regexp_extract_all(text, F.lit(pattern), 0)
    key = lambda p: plain(F.regexp_extract(p, r"^((?:[^=\\]|\\.)+)=", 1))
    value = lambda p: F.regexp_extract(p, r"^(?:[^=\\]|\\.)+=(.*)$", 1)
    tag = F.transform(pairs(F.regexp_extract(c, shape, 2), r"(?:[^,=\\]|\\.)+=(?:[^,\\]|\\.)*"), lambda p: F.struct(key(p).alias("k"), plain(value(p)).alias("v")))
    fields = F.transform(pairs(F.regexp_extract(c, shape, 3), r'(?:[^,=\\]|\\.)+=(?:"(?:[^"\\]|\\.)*"|[^,]*)'), lambda p: F.struct(key(p).alias("k"), F.regexp_replace(F.regexp_replace(value(p), '^"|"$', ""), r"^(-?\d+)[iu]$", "$1").alias("v")))
    return rows.select(plain(F.regexp_extract(c, shape, 1)).alias("measurement"), F.map_from_entries(tag).alias("tags"), F.map_from_entries(fields).alias("fields"), F.regexp_extract(c, shape, 4).try_cast("long").alias("time_ns"))


def _fetch(url: str) -> Any:
    with urllib.request.urlopen(url, timeout=30) as answer:  # noqa: S310 - the address is the caller's
        return json.loads(answer.read())


def dig(doc: Any, path: str) -> Any:
    """A dotted path into lists and objects."""
    for part in filter(None, path.lstrip("$.").split(".")):
        doc = doc[int(part)] if isinstance(doc, list) and part.isdigit() and int(part) < len(doc) else doc.get(part) if isinstance(doc, dict) else None
        if doc is None:
            return None
    return doc


class _Page(InputPartition):
    def __init__(self, number: int):
        self.number = number


class _PolledReader(DataSourceReader):
    def __init__(self, options: dict[str, str], fetch: Callable[[str], Any]):
        self.options, self.fetch = options, fetch

    def partitions(self) -> list[InputPartition]:
        return [_Page(i) for i in range(int(self.options.get("firstPage", "1")), int(self.options.get("firstPage", "1")) + int(self.options.get("pages", "1")))]

    def read(self, partition: InputPartition) -> Iterator[tuple[int, str]]:
        url = self.options["url"].replace("{page}", str(partition.number)).replace("{size}", self.options.get("pageSize", "100"))
        for event in dig(self.fetch(url), self.options.get("events", "")) or []:
            yield partition.number, json.dumps(event, ensure_ascii=False)


class PolledEvents(DataSource):
    """Events of a paged HTTP interface: format 'polled_events' with the options url ({page} and {size} are filled in), pages, firstPage, pageSize, events (path of the list). One task
    per page. ``spark.dataSource.register(PolledEvents)`` makes it known."""

    @classmethod
    def name(cls) -> str:
        return "polled_events"

    def schema(self) -> str:
        return "page int, event string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ARG002 - fixed schema
        return _PolledReader(self.options, _fetch)
