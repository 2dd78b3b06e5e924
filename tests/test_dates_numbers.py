from datetime import date

from pyspark.sql import functions as F

from dutyflow.functions import dates, numbers


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_holidays(spark, rows):
    got = dict(rows(dates.holidays(spark, 2026, 2026)))
    assert len(got) == 11
    assert got[date(2026, 5, 1)] == "Tag der Arbeit" and got[date(2026, 4, 3)] == "Karfreitag" and got[date(2026, 11, 18)] == "Buß- und Bettag"
    assert one(spark, dates.easter(F.lit(2000))) == date(2000, 4, 23)


def test_calendar_next_day(spark):
    c = {r["date"]: r for r in dates.calendar(spark, 2026, 2026).collect()}
    assert c[date(2026, 5, 1)]["is_holiday"] and c[date(2026, 5, 1)]["next_is_free"]
    assert c[date(2026, 12, 31)]["next_is_holiday"]
    old = {r["date"]: r for r in dates.calendar(spark, 2026, 2026, same_year_only=True).collect()}
    assert not old[date(2026, 12, 31)]["next_is_holiday"]


def test_month_window(spark, rows):
    assert [r[0] for r in rows(dates.month_window(spark, 1, 2, "2026-12-15"), "ym")] == ["2026-11", "2026-12", "2027-01", "2027-02"]
    assert [r[0] for r in rows(dates.month_window(spark, -3, 0, "2026-12-15"), "ym")] == ["2026-12"]
    years = dates.months_by_year(dates.month_window(spark, 1, 1, "2026-12-15")).collect()
    assert {r["year"]: r["months"] for r in years} == {2026: [11, 12], 2027: [1]}


def test_dates(spark):
    assert one(spark, dates.iso_date(F.lit(2026), F.lit(2), F.lit(31))) is None
    assert one(spark, dates.iso_date(F.lit(2024), F.lit(2), F.lit(29))) == date(2024, 2, 29)
    assert one(spark, dates.previous_month(F.lit("2026-01"))) == "2025-12"
    assert one(spark, dates.month_number(F.lit("März"))) == 3
    assert one(spark, dates.month_number(F.lit("xyz"))) is None
    assert one(spark, dates.header_month(F.lit("x\nZeitraum: 07.2026"))) == "2026-07"
    d = F.lit("2026-07-15").cast("date")
    assert one(spark, dates.highlight(F.lit("2026-07-13").cast("date"), d)) == "week"
    assert one(spark, dates.highlight(F.lit("2026-07-31").cast("date"), d)) == "month"


def test_numbers(spark):
    assert one(spark, numbers.cents(F.lit(-0.125))) == -0.12
    assert one(spark, numbers.cents(F.lit(0.125))) == 0.13
    assert one(spark, numbers.duration_hours(F.lit("19:30"), F.lit("07:30"))) == 12.0
    assert one(spark, numbers.duration_hours(F.lit("08:00"), F.lit("08:00"))) == 24.0
    assert one(spark, numbers.german_amount(F.lit("-2.420,30"))) == -2420.3
    assert one(spark, numbers.german_amount(F.lit("–"))) is None
    assert one(spark, numbers.german_hours(F.lit("7,5"))) == 7.5
    assert one(spark, numbers.german_hours(F.lit("abc"))) == 0.0
    h = 0
    for c in "Früh*":
        h = (h * 31 + ord(c)) % 2**32
    assert one(spark, numbers.rolling_hash(F.lit("Früh*"))) == h
    assert one(spark, numbers.box_overlap(*[F.lit(float(x)) for x in (0, 0, 2, 2, 1, 0, 2, 2)])) == 1 / 3
    assert one(spark, numbers.work_percent(F.lit(None).cast("double"), F.lit(19.25), F.lit(38.5))) == 50.0
