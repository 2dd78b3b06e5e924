"""Export of shifts: overnight splits, calendar files, colours, mails."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers, text
from ..session import ship, tasks
from ..sources import store
from .lookups import small

#: Fields that describe a whole duty and stay on its first part only.
DUTY_FIELDS = ("break_minutes", "actual", "account_daily", "oncall_percent", "oncall_rated")


def _overnight() -> Column:
    return numbers.overnight(F.col("start"), F.col("end"), F.col("all_day"))


def split_overnight(shifts: DataFrame) -> DataFrame:
    """Overnight rows become two: up to midnight and from midnight; adds calendar_part, window_start, window_end."""
    part = F.explode(F.when(_overnight(), F.array(F.lit("1/2"), F.lit("2/2"))).otherwise(F.array(F.lit(None).cast("string"))))
    out = shifts.withColumn("window_start", F.when(_overnight(), F.col("start"))).withColumn("window_end", F.when(_overnight(), F.col("end"))).withColumn("calendar_part", part)
    first, second = F.col("calendar_part").eqNullSafe("1/2"), F.col("calendar_part").eqNullSafe("2/2")
    out = out.withColumn("date", F.when(second, F.date_add("date", 1)).otherwise(F.col("date")))
    out = out.withColumn("start", F.when(second, "00:00").otherwise(F.col("start"))).withColumn("end", F.when(first, "00:00").otherwise(F.col("end")))
    for c in DUTY_FIELDS:
        if c in shifts.columns:
            out = out.withColumn(c, F.when(~second, F.col(c)))
    return out


def wipe_range(shifts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """First date and last date (a day later for overnight rows) to clear before an export."""
    last = F.when(_overnight(), F.date_add("date", 1)).otherwise(F.col("date"))
    return shifts.groupBy(*keys).agg(F.min("date").alias("start_date"), F.max(last).alias("end_date")).where("start_date IS NOT NULL")


def ics_fields(shifts: DataFrame, title_times: bool = False, zone: str = "Europe/Berlin") -> DataFrame:
    """Adds uid (a hash, so reruns agree), dtstart, dtend, summary; an all-day event ends the day after."""
    stamp = lambda d, c: F.concat(F.date_format(d, "yyyyMMdd"), F.lit("T"), F.replace(c, F.lit(":"), F.lit("")), F.lit("00"))
    end_date = F.when(_overnight(), F.date_add("date", 1)).otherwise(F.col("date"))
    have = lambda c: F.coalesce(F.col(c), F.lit("")) if c in shifts.columns else F.lit("")
    begin = F.coalesce(F.col("window_start"), F.col("start")) if "window_start" in shifts.columns else F.col("start")
    stop = F.coalesce(F.col("window_end"), F.col("end")) if "window_end" in shifts.columns else F.col("end")
    title = F.col("type")
    if title_times:
        title = F.when(~F.col("all_day") & begin.isNotNull() & stop.isNotNull(), F.concat(F.col("type"), F.lit(" "), begin, F.lit("–"), stop)).otherwise(F.col("type"))
    title = F.when(have("calendar_part") != "", F.concat(title, F.lit(" ("), have("calendar_part"), F.lit(")"))).otherwise(title)
    day = lambda d: F.date_format(d, "yyyyMMdd")
    return shifts.select(
        *shifts.columns,
        F.concat(F.sha2(F.concat_ws("|", have("workplace_id"), F.col("date").cast("string"), "type", have("start"), have("end"), have("calendar_part")), 256), F.lit("@dutyflow")).alias("uid"),
        F.when(F.col("all_day"), F.concat(F.lit("DTSTART;VALUE=DATE:"), day("date"))).otherwise(F.concat(F.lit(f"DTSTART;TZID={zone}:"), stamp(F.col("date"), F.col("start")))).alias("dtstart"),
        F.when(F.col("all_day"), F.concat(F.lit("DTEND;VALUE=DATE:"), day(F.date_add("date", 1)))).otherwise(F.concat(F.lit(f"DTEND;TZID={zone}:"), stamp(end_date, F.col("end")))).alias("dtend"),
        F.concat(F.lit("SUMMARY:"), text.ics_escape(title)).alias("summary"),
    )


def ics_events(shifts: DataFrame, title_times: bool = False, split: bool = False, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, date, uid, event): one VEVENT text for each row."""
    rows = ics_fields(split_overnight(shifts) if split else shifts, title_times)
    get = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    body = text.event_body(F.col("type"), F.col("start"), F.col("end"), F.col("all_day"), get("break_minutes"), get("actual"), get("account_daily"), get("oncall_percent"), get("oncall_rated"))
    event = F.concat_ws("\r\n", F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), "uid"), "summary", F.concat(F.lit("DESCRIPTION:"), text.ics_escape(body)), "dtstart", "dtend", F.lit("END:VEVENT"))
    return rows.select(*keys, "date", "uid", event.alias("event"))


HEAD = "\r\n".join(("BEGIN:VCALENDAR", "VERSION:2.0", "PRODID:-//dutyflow//DE", "CALSCALE:GREGORIAN"))
FOOT = "END:VCALENDAR"


def _framed(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lines of calendars (k, date, uid, event and the keys), with a head and a foot for each key that has events."""
    frame = events.select(*keys).distinct() if keys else events.limit(1).select(F.lit(1).alias("_one"))
    ends = frame.withColumn("_f", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.lit(HEAD).alias("event")), F.struct(F.lit(2).alias("k"), F.lit(FOOT).alias("event")))))
    ends = ends.select(*keys, "_f.k", F.lit(None).cast("date").alias("date"), F.lit("").alias("uid"), "_f.event")
    return ends.unionByName(events.select(*keys, F.lit(1).alias("k"), "date", "uid", "event"))


def write_ics(shifts: DataFrame, path: str, **options: bool) -> None:
    """One calendar file: head, events by date, foot. A person's calendar is small, so one task writes it."""
    rows = _framed(ics_events(shifts, **options), [])
    rows.repartition(1).sortWithinPartitions("k", "date", "uid").select("event").write.option("lineSep", "\r\n").mode("overwrite").text(path)


def write_calendars(shifts: DataFrame, key: str, path: str, **options: bool) -> None:
    """A calendar file for each value of ``key`` (in folders key=value, as Spark's writer makes them), all of them by one distributed job.

    Where all machines see the folder as a local one (file:), tasks write the files themselves:
    Hadoop starts a process (chmod) there for each folder, file and checksum, some 5 ms each.
    Elsewhere Spark writes, and tasks put their files in place (commit algorithm 2): else the driver
    would move them one by one at the end. _SUCCESS says that all are there."""
    spark = shifts.sparkSession
    events = ics_events(shifts, **options, keys=[key]).withColumn(key, F.nullif(F.col(key).cast("string"), F.lit("")))
    dealt = _framed(events, [key]).repartition(tasks(spark), key).sortWithinPartitions(key, "k", "date", "uid").select(key, "event")
    folder = store.local_folder(spark, path)
    if folder is None:
        dealt.write.option("lineSep", "\r\n").option("mapreduce.fileoutputcommitter.algorithm.version", "2").mode("overwrite").partitionBy(key).text(path)
        return
    ship(spark)
    store.remove(spark, path)
    dealt.mapInArrow(store.keyed_writer(folder, "calendar.txt", "\r\n"), "files long").agg(F.sum("files")).collect()
    store.succeeded(spark, path)


def nearest_colour(code: Column, palette: Sequence[tuple[int, str]]) -> Column:
    """Palette id of an equal colour, else of the nearest by squared distance (the smaller id of equal ones); null for no colour."""
    best = F.array_min(F.array(*[F.struct(numbers.colour_distance(code, F.lit(h)).alias("d"), F.lit(i).alias("i")) for i, h in palette]))
    return F.when(code.rlike("^#?[0-9a-fA-F]{6}$"), best["i"])


def colour_of_code(rows: DataFrame, colours: DataFrame, code: str) -> DataFrame:
    """Adds ``colour``: of the code, or of the code without a final star; else a stable hue."""
    c = colours.select(F.col("code").alias("_c"), F.col("hex").alias("_h"))
    base = colours.select(F.col("code").alias("_b"), F.col("hex").alias("_g"))
    plain = F.regexp_replace(F.col(code), r"\*$", "")
    out = rows.join(small(c), F.col(code) == F.col("_c"), "left").join(small(base), plain == F.col("_b"), "left")
    hue = F.concat(F.lit("hsl("), numbers.hue(text.short_label(F.col(code))), F.lit(" 55% 42%)"))
    return out.withColumn("colour", F.coalesce("_h", "_g", hue)).drop("_c", "_h", "_b", "_g")


def mapping_fragment(rows: DataFrame) -> DataFrame:
    """One row: JSON of times to codes for a contribution; rows: (times, code) of a user's overrides."""
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("times", "code"))))
    return rows.agg(F.to_json(pairs).alias("fragment"))


def sync_totals(results: DataFrame) -> DataFrame:
    """All and any success and summed counts of export targets: (target, ok, created, deleted)."""
    return results.agg(F.bool_and("ok").alias("all_ok"), F.bool_or("ok").alias("any_ok"), F.sum("created").alias("created"), F.sum("deleted").alias("deleted"))
