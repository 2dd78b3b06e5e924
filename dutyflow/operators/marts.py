"""Derived views: next shift, week, month grid, reminders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from .lookups import small
from .sequences import keep_first

MOST_REMINDERS = 64


def next_shift(shifts: DataFrame, today: str, keys: Sequence[str], order: str) -> DataFrame:
    """The earliest row of each key from ``today`` on (all-day before timed)."""
    rows = shifts.where(F.col("date") >= F.lit(today).cast("date"))
    rank = F.struct("date", F.coalesce("start", F.lit("")).alias("start"), order)
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in keys]), rank).alias("r"))
    return best.select(*keys, "r.*")


def week_view(shifts: DataFrame, any_day: str, keys: Sequence[str], order: str) -> DataFrame:
    """Seven days (Monday first) for each key: up to two codes and the first time; empty days too."""
    start = dates.week_start(F.lit(any_day).cast("date"))
    days = F.explode(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.date_add(start, i)))
    spine = shifts.select(*keys).distinct().withColumn("date", days)
    rows = shifts.where((F.col("date") >= start) & (F.col("date") <= F.date_add(start, 6)))
    rows = rows.groupBy(*keys, "date").agg(F.slice(F.array_sort(F.collect_list(F.struct(order, "type", "start"))), 1, 2).alias("c"))
    out = spine.join(rows, [*keys, "date"], "left")
    codes = F.array_join(F.transform("c", lambda x: x["type"]), "+")
    return out.select(*keys, "date", F.coalesce(codes, F.lit("")).alias("codes"), F.coalesce(F.try_element_at("c", F.lit(1))["start"], F.lit("")).alias("first_time"))


def month_grid(shifts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key x day of the month, codes joined with '+'."""
    rows = shifts.withColumn("day", F.dayofmonth("date")).groupBy(*keys, "day", "type").agg(F.min("start").alias("start"))
    rows = rows.groupBy(*keys, "day").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "type"))), lambda x: x["type"]), "+").alias("cell"))
    return rows.groupBy(*keys).pivot("day", list(range(1, 32))).agg(F.first("cell"))


def months_with_data(shifts: DataFrame, keys: Sequence[str]) -> DataFrame:
    return shifts.groupBy(*keys, F.year("date").alias("year")).agg(F.array_sort(F.collect_set(F.month("date"))).alias("months"))


def entries_by_date(shifts: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The entries of each key (a tenant or person) and date in order: an array of one person's day, not of a day of all."""
    return shifts.groupBy(*keys, "date").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "type", "start", "end"))), lambda x: x.dropFields(order)).alias("entries"))


def slot_fits(when: Column, day: Column) -> Column:
    """Does a slot for a kind of day ('any', 'weekday', 'weekend', 'friday', 'mon-thu') apply on the day?"""
    d = F.weekday(day)
    kinds = {"any": F.lit(True), "weekend": d >= 5, "weekday": d < 5, "friday": d == 4, "mon-thu": d < 4}
    out = F.lit(False)
    for kind, fits in kinds.items():
        out = F.when(when == kind, fits).otherwise(out)
    return out


def slot_by_when(days: DataFrame, slots: DataFrame, day: str) -> DataFrame:
    """Time of a duty column on each day: a slot for the day's kind beats 'any', then slot order.

    slots: ord, when, start, end, as slot_fits() knows them."""
    rows = days.join(small(slots), slot_fits(F.col("when"), F.col(day)), "left")
    rank = F.struct((F.col("when") == "any").cast("int").alias("r"), "ord")
    return rows.groupBy(*days.columns).agg(F.min_by(F.struct("start", "end"), rank).alias("s")).select(*days.columns, "s.start", "s.end")


def reminder_times(prefs: DataFrame, key: str) -> DataFrame:
    """Distinct reminders of each key, ascending, seven at most."""
    return prefs.groupBy(key).agg(F.slice(F.array_sort(F.collect_set("minutes")), 1, 7).alias("minutes"))


def plan_reminders(shifts: DataFrame, prefs: DataFrame, now: str, horizon: str, ties: Sequence[str], most: int = MOST_REMINDERS) -> DataFrame:
    """Reminders (fire_at) of shifts that start after ``now`` and up to ``horizon``: those of
    the shift's code, else the defaults ('*'); late ones are dropped, the first ``most`` kept.

    shifts: code, start_at (timestamp); prefs: code, minutes before the start."""
    t = lambda x: F.lit(x).cast("timestamp")
    rules = prefs.groupBy("code").agg(F.collect_set("minutes").alias("minutes"))
    default = F.broadcast(rules.where("code = '*'").select(F.col("minutes").alias("_default")))  # one row
    rows = shifts.where((F.col("start_at") > t(now)) & (F.col("start_at") <= t(horizon)))
    rows = rows.join(small(rules.where("code <> '*'")), "code", "left").join(default, F.lit(True), "left")
    rows = rows.withColumn("m", F.explode(F.coalesce("minutes", "_default"))).withColumn("fire_at", F.col("start_at") - F.make_dt_interval(mins=F.col("m")))
    return rows.where(F.col("fire_at") > t(now)).drop("minutes", "_default", "m").orderBy("fire_at", *ties).limit(most)


def reminder_codes(codes: DataFrame, colours: DataFrame) -> DataFrame:
    """Codes to choose from: the first row of each upper-cased code in table order, with its colour."""
    first = keep_first(codes.withColumn("_u", F.upper("code")), ["_u"], ["ord"])
    return first.join(small(colours.select(F.upper("code").alias("_u"), "hex")), "_u", "left").select("code", "hex", "ord")


def scroll_target(shifts: DataFrame, today: str) -> DataFrame:
    """The date to show first: today or a later day of its week, else the first day of the month with data, else the first day."""
    d, t = F.col("date"), F.lit(today).cast("date")
    rank = F.when((d >= t) & (dates.week_start(d) == dates.week_start(t)), 0).when(dates.ym(d) == dates.ym(t), 1).otherwise(2)
    return shifts.agg(F.min_by("date", F.struct(rank.alias("r"), "date")).alias("date"))
