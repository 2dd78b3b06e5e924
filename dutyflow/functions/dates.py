"""Calendar functions and the date dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: day of the week (Monday 0) and month names as they stand in documents
WEEKDAYS = ("Mo", "Di", "Mi", "Do", "Fr", "Sa", "So")
MONTHS = {
    "januar": 1, "februar": 2, "märz": 3, "maerz": 3, "april": 4, "mai": 5, "juni": 6, "juli": 7,
    "august": 8, "september": 9, "oktober": 10, "november": 11, "dezember": 12,
}
# fixed values: short month names of German titles
MONTHS_SHORT = ("Jan.", "Feb.", "März", "Apr.", "Mai", "Juni", "Juli", "Aug.", "Sept.", "Okt.", "Nov.", "Dez.")


def ym(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def iso_date(year: Column, month: Column, day: Column) -> Column:
    """A date, or null if there is no such day."""
    text = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    return parse_date(text)


def parse_date(text: Column, pattern: str = "yyyy-MM-dd") -> Column:
    """A date from text; null for what is no real day."""
    return F.to_date(F.try_to_timestamp(text, F.lit(pattern)))


def week_start(date: Column) -> Column:
    return F.date_trunc("week", date).cast("date")


def weekday_label(date: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in WEEKDAYS]), F.weekday(date) + 1)


def german_date(date: Column) -> Column:
    """'3.7.2026'."""
    return F.date_format(date, "d.M.yyyy")


def _of(names: list[str], date: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in names]), F.month(date))


def month_title(date: Column) -> Column:
    """'Juli 2026'."""
    return F.concat_ws(" ", _of([k.capitalize() for k in MONTHS if k != "maerz"], date), F.year(date).cast("string"))


def week_title(monday: Column) -> Column:
    """'29. Juni – 5. Juli 2026': a week by its first and last day."""
    last = F.date_add(monday, 6)
    show = lambda d: F.concat(F.dayofmonth(d).cast("string"), F.lit(". "), _of(list(MONTHS_SHORT), d))
    return F.concat(show(monday), F.lit(" – "), show(last), F.lit(" "), F.year(last).cast("string"))


def month_number(name: Column) -> Column:
    """1..12 of a German month name or its first three letters; null if unknown."""
    low = F.lower(F.trim(name))
    out = F.lit(None).cast("int")
    for key, number in {k.replace("ä", "a")[:3]: n for k, n in MONTHS.items()}.items():
        out = F.when(F.substring(F.translate(low, "äöü", "aou"), 1, 3) == key, F.lit(number)).otherwise(out)
    return out


def previous_month(month: Column) -> Column:
    """The month before 'YYYY-MM'."""
    return ym(F.add_months(F.to_date(F.concat(month, F.lit("-01"))), -1))


def easter(year: Column) -> Column:
    """Easter Sunday of the Gregorian calendar (anonymous computus)."""
    div = lambda a, b: F.floor(a / b)
    a, b, c = year % 19, div(year, 100), year % 100
    d, e = div(b, 4), b % 4
    g = div(b - div(b + 8, 25) + 1, 3)
    h = (19 * a + b - d - g + 15) % 30
    i, k = div(c, 4), c % 4
    w = (32 + 2 * e + 2 * i - h - k) % 7
    m = div(a + 11 * h + 22 * w, 451)
    n = h + w - 7 * m + 114
    return F.make_date(year.cast("int"), div(n, 31).cast("int"), (n % 31 + 1).cast("int"))


def holidays(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """(date, holiday): the eleven statutory holidays of Saxony in each year."""
    y, e = F.col("year"), F.col("easter")
    fixed = lambda month, day: F.make_date(y, F.lit(month), F.lit(day))
    # the Wednesday from 16 to 22 November
    repentance = F.date_add(fixed(11, 16), F.pmod(2 - F.weekday(fixed(11, 16)), F.lit(7)).cast("int"))
    named = {
        "Neujahr": fixed(1, 1),
        "Karfreitag": F.date_add(e, -2),
        "Ostermontag": F.date_add(e, 1),
        "Tag der Arbeit": fixed(5, 1),
        "Christi Himmelfahrt": F.date_add(e, 39),
        "Pfingstmontag": F.date_add(e, 50),
        "Tag der Deutschen Einheit": fixed(10, 3),
        "Reformationstag": fixed(10, 31),
        "Buß- und Bettag": repentance,
        "1. Weihnachtstag": fixed(12, 25),
        "2. Weihnachtstag": fixed(12, 26),
    }
    years = spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("year")).withColumn("easter", easter(y))
    rows = F.explode(F.array(*[F.struct(d.alias("date"), F.lit(n).alias("holiday")) for n, d in named.items()]))
    return years.select(rows.alias("h")).select("h.date", "h.holiday")


def calendar(spark: SparkSession, first_year: int, last_year: int, same_year_only: bool = False) -> DataFrame:
    """The date dimension: weekday flags, holiday, and the flags of the next day.

    The next day of 31 December is looked up in its own year; with
    ``same_year_only`` it is not seen as a holiday, as older tools had it."""
    days = spark.sql(f"SELECT explode(sequence(DATE'{first_year}-01-01', DATE'{last_year}-12-31', INTERVAL 1 DAY)) AS date")
    off = F.broadcast(holidays(spark, first_year, last_year + 1))  # eleven rows for each year
    out = days.join(off, "date", "left").withColumn("next_date", F.date_add("date", 1))
    out = out.join(off.select(F.col("date").alias("next_date"), F.col("holiday").alias("next_holiday")), "next_date", "left")
    if same_year_only:
        out = out.withColumn("next_holiday", F.when(F.year("next_date") == F.year("date"), F.col("next_holiday")))
    weekend = F.weekday("next_date") >= 5
    return out.select(
        "date", F.weekday("date").alias("dow"), weekday_label(F.col("date")).alias("weekday"), (F.weekday("date") >= 5).alias("is_weekend"),
        F.col("holiday").isNotNull().alias("is_holiday"), "holiday", "next_date", F.col("next_holiday").isNotNull().alias("next_is_holiday"),
        (weekend | F.col("next_holiday").isNotNull()).alias("next_is_free"), ym(F.col("date")).alias("ym"),
    )


def highlight(date: Column, today: Column) -> Column:
    """'today', 'week' or 'month' by nearness to ``today``, else null."""
    return F.when(date == today, "today").when(week_start(date) == week_start(today), "week").when(ym(date) == ym(today), "month")


def month_window(spark: SparkSession, before: int, after: int, now: str) -> DataFrame:
    """(ym, year, month) from ``before`` months back to ``after`` ahead; negative counts are 0."""
    start, end = f"add_months(trunc(DATE'{now}', 'MM'), -{max(0, before)})", f"add_months(trunc(DATE'{now}', 'MM'), {max(0, after)})"
    rows = spark.sql(f"SELECT explode(sequence({start}, {end}, INTERVAL 1 MONTH)) AS m")
    return rows.select(ym(F.col("m")).alias("ym"), F.year("m").alias("year"), F.month("m").alias("month"))


def months_by_year(months: DataFrame) -> DataFrame:
    """(year, months): distinct months of each year, ascending."""
    return months.groupBy("year").agg(F.array_sort(F.collect_set("month")).alias("months"))


def next_reminder(last: Column, every_days: Column, now: Column) -> Column:
    """When the next fetch is due: the last one plus the interval, at the earliest now."""
    return F.greatest(now, F.coalesce(last + F.make_dt_interval(every_days), now))


def overdue(last: Column, every_days: Column, now: Column) -> Column:
    return F.coalesce(last + F.make_dt_interval(every_days) < now, F.lit(True))


def header_month(text: Column) -> Column:
    """'YYYY-MM' from the first header of the kinds 'Abrechnungsmonat 07/2026' or 'Zeitraum: 07.2026'; else null."""
    own, other = r"(?iu)Abrechnungsmonat\s+(\d{2})/(\d{4})", r"(?iu)(?:Monat|Zeitraum|Periode)[^\d]{0,12}(\d{2})[./](\d{4})"
    found = lambda p: F.when(text.rlike(p), F.concat_ws("-", F.regexp_extract(text, p, 2), F.regexp_extract(text, p, 1)))
    return F.coalesce(found(own), found(other))
