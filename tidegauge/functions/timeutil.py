"""Durations, request times, alignment and time buckets."""

from __future__ import annotations

import datetime as dt
import re
import zoneinfo

from pyspark.sql import Column
from pyspark.sql import functions as F

# Milliseconds of the duration units.
UNIT_MS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000, "y": 31_536_000_000}
_DURATION = re.compile(r"(\d+)(ms|[smhdwy])")
_LAYOUTS = ("%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M:%SZ", "%Y-%m-%d")


def duration_ms(text: str) -> int:
    """Milliseconds of '1m', '2h30m', '-5m'; ValueError for anything else."""
    body, sign = text.lstrip("+-"), -1 if text.startswith("-") else 1
    if not body or _DURATION.sub("", body):
        raise ValueError(f"no duration: {text!r}")
    return sign * sum(int(n) * UNIT_MS[u] for n, u in _DURATION.findall(body))


def request_time_ms(text: str | int | float) -> int:
    """A request's time as ms: s, ms, us or ns by the number of digits, decimal seconds, or a date text in UTC."""
    s = str(text).strip()
    if re.fullmatch(r"-?\d+\.\d+", s):
        return round(float(s) * 1000)
    if re.fullmatch(r"-?\d+", s):
        n, digits = int(s), len(s.lstrip("-"))
        return n * 1000 if digits <= 10 else n if digits <= 13 else n // 1000 if digits <= 16 else n // 1_000_000
    for layout in _LAYOUTS:
        try:
            return int(dt.datetime.strptime(s, layout).replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
        except ValueError:
            continue
    raise ValueError(f"no time: {text!r}")


def zone_offset_ms(zone: str, at_ms: int = 0) -> int:
    """The zone's offset at one instant; buckets use it for the whole range, across clock changes too."""
    moment = dt.datetime.fromtimestamp(at_ms / 1000, zoneinfo.ZoneInfo(zone))
    return int(moment.utcoffset().total_seconds() * 1000)


def align_ms(at_ms: int, step_ms: int, zone: str = "UTC") -> int:
    """The last step border at or before ``at_ms``, in the zone."""
    offset = zone_offset_ms(zone, at_ms)
    return (at_ms + offset) // step_ms * step_ms - offset


def steps(start_ms: int, end_ms: int, step_ms: int) -> list[int]:
    return list(range(start_ms, end_ms + 1, step_ms))


def bucket_ms(at: Column, window_ms: int, offset_ms: int = 0) -> Column:
    """Start of the time bucket of ``at`` (ms); floor also for instants before 1970."""
    shifted = at + F.lit(offset_ms)
    return shifted - F.pmod(shifted, F.lit(window_ms)) - F.lit(offset_ms)


def to_ms(at: Column, unit: str) -> Column:
    """A time column in s, ms, us or ns as ms."""
    if unit not in ("s", "ms", "us", "ns"):
        raise ValueError(f"no time unit: {unit!r}")
    at = at.cast("long")
    return {"s": at * 1000, "ms": at, "us": F.floor(at / 1000).cast("long"), "ns": F.floor(at / 1_000_000).cast("long")}[unit]


def round_ms(at: Column, precision_ms: int) -> Column:
    """Nearest multiple, halves upward (record cleaning rounds; queries floor)."""
    return (F.floor((at + precision_ms // 2) / precision_ms) * precision_ms).cast("long")


def event_ms(ts: Column) -> Column:
    """ms of a timestamp column under a UTC session."""
    return F.unix_millis(ts.cast("timestamp"))


def bounded(at: Column, start: int, end: int, bounds: str = "[)") -> Column:
    """start/end filter with any of the bounds '[)', '[]', '()', '(]'."""
    low = at >= start if bounds[0] == "[" else at > start
    return low & (at < end if bounds[1] == ")" else at <= end)


def days_between(start_ms: int, end_ms: int, zone: str = "UTC") -> list[str]:
    """The yyyymmdd days that a range touches: the partitions to read."""
    z = zoneinfo.ZoneInfo(zone)
    a, b = (dt.datetime.fromtimestamp(x / 1000, z).date() for x in (start_ms, end_ms))
    return [(a + dt.timedelta(days=i)).strftime("%Y%m%d") for i in range((b - a).days + 1)]


def day_partition(column: Column, start_ms: int, end_ms: int, zone: str = "Asia/Shanghai", slack_ms: int = 1000) -> Column:
    """Partition predicate derived from a time range: a day column between the range's first and last day (with slack at its end)."""
    days = days_between(start_ms, end_ms + slack_ms, zone)
    return column.between(int(days[0]), int(days[-1]))
