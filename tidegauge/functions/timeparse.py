"""Reading time written in many notations, as JVM-side column expressions.

``instant_us`` gives microseconds since 1970-01-01 UTC or null. Nothing depends on the
session's time zone and nothing raises: what cannot be read is null.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# English month abbreviations and the zone abbreviations that are read (hours east of UTC).
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 1, "BST": 1, "CET": 1, "CEST": 2, "EET": 2, "EEST": 3, "MSK": 3,
    "IST": 5.5, "JST": 9, "KST": 9, "AEST": 10, "AEDT": 11, "NZST": 12, "NZDT": 13,
    "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7,
}
#: Offsets in use lie between these hours; an hour count outside is no zone.
LEAST_HOURS, MOST_HOURS = -12, 14

_TIME = r"(\d{1,2}):(\d{2}):(\d{2})(?:[.,](\d+))?"
_ZONE = r"\s*(Z|[A-Za-z]{2,5}|(?:UTC|GMT)?[+-]\d{1,2}:?(?:\d{2})?)?"
_MON = r"([A-Za-z]{3})[A-Za-z]*"
_DAY = r"(?:[A-Za-z]{3,9},?\s+)?"
# Each layout: pattern, then the order y|m|d|h|mi|s|fraction|half of day|zone as a replacement.
LAYOUTS: dict[str, tuple[str, str]] = {
    "dashes": (rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})[T ]\s*{_TIME}{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    "slashes": (rf"^(\d{{4}})/(\d{{1,2}})/(\d{{1,2}})[T ]\s*{_TIME}{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    "digits": (rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt]?(\d{{2}})(\d{{2}})(\d{{2}})(?:[.,](\d+))?{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    "signs": (rf"^(\d{{4}})年(\d{{1,2}})月(\d{{1,2}})日\s*{_TIME}{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    "dots": (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})[T ]\s*{_TIME}{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7||$8"),
    "month first": (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})[T ]\s*{_TIME}\s*([AaPp])?(?:\.?[Mm]\.?)?{_ZONE}$", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    "access log": (rf"^(\d{{1,2}})/{_MON}/(\d{{4}}):{_TIME}{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7||$8"),
    "mail": (rf"^{_DAY}(\d{{1,2}})[ -]{_MON}[ -](\d{{4}})[T ]\s*{_TIME}{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7||$8"),
    "date command": (rf"^{_DAY}{_MON}\s+(\d{{1,2}})\s+{_TIME}{_ZONE}\s+(\d{{4}})$", "$8|$1|$2|$3|$4|$5|$6||$7"),
}
_EPOCH = r"^(\d{10}|\d{13}|\d{16}|\d{19})$"
_EPOCH_FRACTION = r"^(\d{10})[.,](\d+)$"


def _zone_names(spark: SparkSession) -> list[str]:
    return sorted(spark._jvm.java.time.ZoneId.getAvailableZoneIds())


def offset_seconds(zone: Column) -> Column:
    """Seconds east of UTC of a zone written as an offset, a number of hours or an abbreviation; else null.

    Read are ``8``, ``-5``, ``5.5``, ``+0530``, ``-04:00``, ``UTC+8``, ``GMT-05:00`` and the fixed abbreviations."""
    z = F.trim(zone)
    signed = r"^(?:UTC|GMT)?\s*([+-]?)(\d{1,2})(?::?(\d{2}))?$"
    sign = F.when(F.regexp_extract(z, signed, 1) == "-", -1).otherwise(1)
    whole = F.regexp_extract(z, signed, 2).try_cast("int") * 3600
    minutes = F.coalesce(F.regexp_extract(z, signed, 3).try_cast("int"), F.lit(0))
    names = F.create_map(*[F.lit(x) for k, v in ABBREVIATIONS.items() for x in (k, int(v * 3600))])
    seconds = (
        F.when(z.rlike(signed), F.when(minutes < 60, sign * (whole + minutes * 60)))
        .when(z.rlike(r"^[+-]?\d{1,2}\.\d+$"), F.round(z.try_cast("double") * 3600).try_cast("int"))
        .when(z.rlike(r"^[A-Za-z]{1,5}$"), F.try_element_at(names, F.upper(z)))
    )
    return F.when(seconds.between(LEAST_HOURS * 3600, MOST_HOURS * 3600), seconds)


def _micros(text: Column) -> Column:
    """Microseconds since 1970 of a date and time in UTC written 'y-m-d h:m:s': the zone is put behind the text, so the session's doesn't matter."""
    return F.unix_micros(F.concat(text, F.lit("Z")).try_cast("timestamp"))


def _fraction(digits: Column) -> Column:
    return F.coalesce(F.rpad(F.substring(digits, 1, 6), 6, "0").try_cast("long"), F.lit(0))


_PLAIN_UTC = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"


def instant_us(spark: SparkSession, text: Column, default_zone: Column, named_zones: bool = True) -> Column:
    """Microseconds since 1970 UTC that ``text`` means; a zone in the text goes before ``default_zone``.

    Whole numbers of 10, 13, 16 and 19 digits count s, ms, us and ns since 1970; 14 digits are date and time. Slashed dates that don't start
    with the year are month-first, dotted ones day-first. A local time that occurs twice means its first occurrence; one that a clock change
    skips is read with the offset before the change. Digits finer than a microsecond are cut off. Null: no valid time, or a local time
    without a usable zone. ``named_zones=False`` leaves out zone names.

    The steps are chained as lambdas over an array of one element: each step's outcome is computed once, and the many patterns stay out of
    the generated code of the stage, which they would push over its size limit."""
    names = _zone_names(spark) if named_zones else []
    month_names = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS) for x in (m, str(i + 1))])

    def laid_out(x: Column) -> Column:
        # The first characters leave one layout, or two, so that a text meets one pattern; what it doesn't match comes back unchanged.
        s = x["s"]
        head, fifth = F.substring(s, 1, 3), F.substring(s, 5, 1)
        apply = lambda name: F.regexp_replace(s, *LAYOUTS[name])
        after_slash = F.substr(s, F.instr(s, "/") + 1, F.lit(1))
        read = (
            F.when(head.contains("/"), F.when(after_slash > "9", apply("access log")).otherwise(apply("month first")))
            .when(head.contains("."), apply("dots"))
            .when(fifth == "-", apply("dashes"))
            .when(fifth == "/", apply("slashes"))
            .when(fifth == "年", apply("signs"))
            .when(head.between("0", ":") & fifth.between("0", "9"), apply("digits"))
            .when(s.rlike(LAYOUTS["mail"][0]), apply("mail"))
            .otherwise(apply("date command"))
        )
        return F.struct(s.alias("s"), x["zone"].alias("zone"), read.alias("read"))

    def parted(x: Column) -> Column:
        return F.struct(x["s"].alias("s"), x["zone"].alias("zone"), F.when(x["read"] != x["s"], F.split(x["read"], r"\|")).alias("p"))

    def pieces(x: Column) -> Column:
        p, hour = x["p"], F.get(x["p"], 3).try_cast("int")
        month = F.get(p, 1)
        half = F.lower(F.get(p, 7))
        clock = (
            F.when(half == "", hour)
            .when(hour.between(1, 12) & (half == "p"), hour % 12 + 12)
            .when(hour.between(1, 12) & (half == "a"), hour % 12)
        )
        month = F.when(month.rlike("^[A-Za-z]"), F.try_element_at(month_names, F.lower(month))).otherwise(month)
        day = F.concat(F.get(p, 0), F.lit("-"), month, F.lit("-"), F.get(p, 2))
        told = F.concat(day, F.lit(" "), clock.cast("string"), F.lit(":"), F.get(p, 4), F.lit(":"), F.get(p, 5))
        stated = F.when(F.get(p, 8) != "", F.get(p, 8)).otherwise(F.trim(x["zone"]))
        return F.struct(x["s"].alias("s"), p.alias("p"), told.alias("told"), stated.alias("zone"), offset_seconds(stated).alias("offset"))

    def instant(x: Column) -> Column:
        s, told, zone = x["s"], x["told"], x["zone"]
        local = F.when(x["offset"].isNotNull(), _micros(told) - x["offset"].cast("long") * 1_000_000)
        if names:
            utc = F.convert_timezone(zone, F.lit("UTC"), told.try_cast("timestamp_ntz"))
            local = local.when(zone.isin(names), _micros(utc.cast("string")))
        number, digits = s.try_cast("decimal(20,0)"), F.length(s)
        epoch = (
            F.when(digits == 10, number * 1_000_000)
            .when(digits == 13, number * 1_000)
            .when(digits == 16, number)
            .otherwise(F.substring(s, 1, 16).try_cast("decimal(20,0)"))
            .cast("long")
        )
        whole = F.regexp_extract(s, _EPOCH_FRACTION, 1).try_cast("long") * 1_000_000
        fractional = whole + _fraction(F.regexp_extract(s, _EPOCH_FRACTION, 2))
        spelled = local + _fraction(F.get(x["p"], 6))
        return F.when(x["p"].isNotNull(), spelled).when(s.rlike(_EPOCH), epoch).when(s.rlike(_EPOCH_FRACTION), fractional)

    tidy = F.trim(F.regexp_replace(text, r"[\t\r\n 　]+", " "))
    one = F.array(F.struct(tidy.alias("s"), default_zone.cast("string").alias("zone")))
    return F.get(F.transform(F.transform(F.transform(F.transform(one, laid_out), parted), pieces), instant), 0)


def utc_us(spark: SparkSession, text: Column) -> Column:
    """``instant_us`` of a column that is UTC unless it says otherwise, with a short way for the usual notation."""
    return F.when(text.rlike(_PLAIN_UTC), _micros(text)).otherwise(instant_us(spark, text, F.lit("UTC"), named_zones=False))


def ntz_us(ts: Column) -> Column:
    """Microseconds of a timestamp column in UTC without zone (TIMESTAMP_NTZ, or TIMESTAMP under a UTC session)."""
    session = SparkSession.getActiveSession()
    if session is not None and session.conf.get("spark.sql.session.timeZone") == "UTC":
        return F.unix_micros(ts.cast("timestamp"))
    return _micros(ts.cast("timestamp_ntz").cast("string"))
