"""Numeric and clock functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cents(x: Column) -> Column:
    """Rounds to cents, halves up towards plus infinity (also below zero)."""
    return F.floor(x * 100 + F.lit(0.5)) / 100


def minutes(clock: Column) -> Column:
    """Minutes of the day of H:MM or HH:MM; null if it is no clock time."""
    hit = F.regexp_extract(clock, r"^\s*(\d{1,2}):(\d{2})\s*$", 1)
    rest = F.regexp_extract(clock, r"^\s*(\d{1,2}):(\d{2})\s*$", 2)
    return F.when(hit != "", hit.cast("int") * 60 + rest.cast("int"))


def duration_hours(start: Column, end: Column) -> Column:
    """Decimal hours from start to end; an end at or before the start is on the next day."""
    span = minutes(end) - minutes(start)
    return cents(F.when(span <= 0, span + 1440).otherwise(span) / 60.0)


def overnight(start: Column, end: Column, all_day: Column) -> Column:
    """A timed shift whose end clock is before its start clock; false for nulls."""
    return F.coalesce(~F.coalesce(all_day, F.lit(False)) & (end < start), F.lit(False))


def german_hours(text: Column) -> Column:
    """'7,5' -> 7.5; null and what is no number: 0. Thousands dots are not understood."""
    return F.coalesce(_double(F.regexp_replace(F.replace(text, F.lit(","), F.lit(".")), r"\s", "")), F.lit(0.0))


def german_amount(text: Column) -> Column:
    """'2.420,30' -> 2420.30; null for what is no number."""
    plain = F.replace(F.replace(F.regexp_replace(text, r"\s", ""), F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return cents(_double(plain))


def _double(text: Column) -> Column:
    return F.when(text.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)$"), text.cast("double"))


def rolling_hash(text: Column) -> Column:
    """h * 31 + code point, modulo 2**32, over the characters."""
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(letters, F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + F.ascii(c), F.lit(1 << 32)))


def hue(text: Column) -> Column:
    return F.pmod(rolling_hash(text), F.lit(360)).cast("int")


def hex_channel(code: Column, i: int) -> Column:
    """Red, green or blue (0, 1, 2) of a #rrggbb colour."""
    return F.conv(F.substring(F.regexp_replace(code, "^#", ""), 2 * i + 1, 2), 16, 10).cast("int")


def colour_distance(a: Column, b: Column) -> Column:
    """Squared distance of two #rrggbb colours."""
    parts = [(hex_channel(a, i) - hex_channel(b, i)) * (hex_channel(a, i) - hex_channel(b, i)) for i in range(3)]
    return parts[0] + parts[1] + parts[2]


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def work_percent(percent: Column, hours: Column, full: Column) -> Column:
    """The percentage if given, else hours of the full week, else 100."""
    return F.coalesce(F.when(percent > 0, percent), F.when((hours > 0) & (full > 0), cents(hours / full * 100)), F.lit(100.0))


def box_overlap(ax: Column, ay: Column, aw: Column, ah: Column, bx: Column, by: Column, bw: Column, bh: Column) -> Column:
    """Intersection over union of two rectangles."""
    w = F.greatest(F.lit(0.0), F.least(ax + aw, bx + bw) - F.greatest(ax, bx))
    h = F.greatest(F.lit(0.0), F.least(ay + ah, by + bh) - F.greatest(ay, by))
    union = aw * ah + bw * bh - w * h
    return F.when(union > 0, w * h / union).otherwise(F.lit(0.0))
