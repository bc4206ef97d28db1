"""Column expressions that many operators share."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
COMPARISONS = (">", ">=", "<", "<=", "==", "!=")


def quoted(name: str) -> Column:
    """A column by its literal name, whatever characters it has."""
    return F.col(f"`{name.replace('`', '``')}`")


def wall_seconds(ts: Column) -> Column:
    """Seconds since 1970 of a zoneless timestamp, read as UTC whatever the session's zone."""
    return F.unix_micros(F.from_utc_timestamp(ts.cast("timestamp"), F.current_timezone())) / F.lit(1e6)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; the root is clamped so that rounding never leaves asin's domain."""
    a, b = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    inner = a * a + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * b * b
    # not least(): that would take 1 where a coordinate is null
    return F.lit(2 * EARTH_KM) * F.asin(F.when(inner > 1, F.lit(1.0)).otherwise(F.sqrt(inner)))


def nearest_multiple(x: Column, step: float) -> Column:
    """The nearest multiple of ``step`` as a long, ties to the even one."""
    return (F.rint(x / F.lit(float(step))) * F.lit(float(step))).cast("long")


def tick(seconds: Column, hz: float = 10.0) -> Column:
    """The grid tick of a time: rounded half away from zero."""
    return F.round(seconds * F.lit(float(hz))).cast("long")


def geo_cell(degrees: Column, size: float) -> Column:
    return F.round(degrees / F.lit(size)) * F.lit(size)


def magnitude(columns: list[Column]) -> Column:
    """Euclidean length of several columns; null if any is."""
    total = columns[0] * columns[0]
    for c in columns[1:]:
        total = total + c * c
    return F.sqrt(total)


def edge_key(a: Column, b: Column) -> Column:
    return F.concat_ws("::", F.array_sort(F.array(a, b)))


def short_id(text: Column) -> Column:
    """The first eight digits of a SHA-1."""
    return F.substring(F.sha1(text.cast("binary")), 1, 8)


def period(date: Column, granularity: str) -> Column:
    """The day, month or year of an ISO date string."""
    return F.substring(date.cast("string"), 1, {"day": 10, "month": 7, "year": 4}[granularity])


def compare(x: Column, op: str, bound: float) -> Column:
    """``x op bound``; an unknown operator counts as >."""
    y = F.lit(float(bound))
    return {">": x > y, ">=": x >= y, "<": x < y, "<=": x <= y, "==": x == y, "!=": x != y}.get(op, x > y)


def tokens(text: Column) -> Column:
    """Distinct lower-case words and numbers of a text, with camel and snake case taken apart."""
    apart = F.regexp_replace(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"), "[_\\-]+", " ")
    return F.array_distinct(F.regexp_extract_all(F.lower(apart), F.lit("[a-z0-9]+"), F.lit(0)))


def integrated_unit(unit: str | None) -> str:
    """The unit of the time integral of a per-hour rate: the suffix that says per hour goes."""
    text = (unit or "").strip()
    return re.sub(r"\s*(?:/\s*(?:hour|hr\.?|h)|per hour)$", "", text, flags=re.IGNORECASE) if text else ""


def bucket_seconds(spec) -> float:
    """Seconds of a bucket: a number is hours; minute, hour, day; or a number with s, m, h or d; else an hour."""
    if isinstance(spec, int | float) and not isinstance(spec, bool):
        return float(spec) * 3600 if spec > 0 else 3600.0
    text = str(spec or "").strip().lower()
    named = {"minute": 60.0, "hour": 3600.0, "day": 86400.0, "minutely": 60.0, "hourly": 3600.0, "daily": 86400.0}
    if text in named:
        return named[text]
    m = re.fullmatch(r"(\d+(?:\.\d+)?)\s*([smhd])", text)
    if m and float(m[1]) > 0:
        return float(m[1]) * {"s": 1, "m": 60, "h": 3600, "d": 86400}[m[2]]
    return 3600.0
