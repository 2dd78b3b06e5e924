"""Readers: CSV and calendar files to shifts, text lines, landing folders, the source registry."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dates import parse_date
from ..session import tasks
from . import store

_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


class MissingColumns(ValueError):
    """A CSV header without date or type."""


def whole_files(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """(src_doc, content) of text files."""
    return spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("src_doc"), F.col("value").alias("content"))


def keyed_files(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(src_doc, content) of the text files in folders key=value of ``path``, by value.

    The folders are listed by as many tasks as keep the cores busy: Spark's own
    number is one for each folder, up to 10,000. So many tasks read the files, too,
    of which a split holds few. They are read as binary ones: the reader of texts
    copies the settings of Hadoop for each file. The value comes from the path: Spark's
    discovery of partitions takes time by the square of their number."""
    before = spark.conf.get(_LISTING)
    spark.conf.set(_LISTING, str(tasks(spark)))
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    finally:
        spark.conf.set(_LISTING, before)
    own = F.regexp_extract("path", f"/{re.escape(key)}=([^/]*)/[^/]*$", 1)
    value = F.url_decode(F.replace(own, F.lit("+"), F.lit("%2B")))  # %XX stands for a character that names of folders cannot have
    return files.select(F.nullif(value, F.lit(store.NULL)).alias("src_doc"), F.col("content").cast("string").alias("content")).coalesce(tasks(spark))


def csv_fields(line: Column) -> Column:
    """Fields of a CSV line: commas inside quotes do not split, quotes vanish (doubled ones too), blanks are trimmed.

    The text between quotes is every second piece of a split at quotes."""
    pieces = F.transform(F.split(line, '"'), lambda p, i: F.when(i % 2 == 1, F.replace(p, F.lit(","), F.lit("\u0000"))).otherwise(p))
    return F.transform(F.split(F.array_join(pieces, ""), ","), lambda f: F.trim(F.replace(f, F.lit("\u0000"), F.lit(","))))


def csv_shifts(files: DataFrame) -> DataFrame:
    """Shifts of CSV files (src_doc, content): columns by header name in any
    order and case; date and type are needed. Rows without an ISO date are
    left out; no times at all means all day. A file without the needed columns
    gives an error at run time, as does its absence of a header."""
    text = F.regexp_replace("content", "^﻿", "")
    lines = F.filter(F.transform(F.split(text, "\r?\n"), F.trim), lambda x: x != "")
    rows = files.withColumn("_lines", lines).where(F.size("_lines") > 0).withColumn("_head", F.transform(csv_fields(F.col("_lines")[0]), F.lower))
    rows = rows.select("src_doc", "_head", F.posexplode(F.slice("_lines", F.lit(2), F.greatest(F.size("_lines") - 1, F.lit(0)))).alias("src_seq", "_line"))
    named = F.array_contains("_head", "date") & F.array_contains("_head", "type")
    rows = rows.withColumn("_f", csv_fields(F.col("_line")))
    get = lambda name: F.nullif(F.when(F.array_position("_head", name) > 0, F.try_element_at("_f", F.array_position("_head", name).cast("int"))), F.lit(""))
    all_day = F.coalesce(F.lower(get("allday")).isin("1", "true", "yes", "ja"), F.lit(False))
    out = rows.select("src_doc", F.col("src_seq").cast("long"), F.when(named, get("date")).otherwise(F.raise_error(F.concat(F.lit("CSV needs the columns date and type: "), "src_doc"))).alias("_d"), get("start").alias("_s"), get("end").alias("_e"), F.coalesce(get("type"), F.lit("SHIFT")).alias("type"), all_day.alias("_all"))
    out = out.where(F.col("_d").rlike(r"^\d{4}-\d{2}-\d{2}$")).withColumn("date", parse_date(F.col("_d"))).where("date IS NOT NULL")
    return out.select(
        "src_doc", "src_seq", "date", F.date_format("date", "yyyy-MM").alias("ym"), "type", F.when(~F.col("_all"), F.col("_s")).alias("start"), F.when(~F.col("_all"), F.col("_e")).alias("end"),
        (F.col("_all") | (F.col("_s").isNull() & F.col("_e").isNull())).alias("all_day"), F.lit(False).alias("is_validated"),
    )


def calendar_shifts(files: DataFrame) -> DataFrame:
    """Shifts of ICS files: unfolded lines, one row for each VEVENT with a
    start; without a clock it is all day; the end date is not read; a missing
    end is the start."""
    text = F.regexp_replace(F.regexp_replace("content", "\r\n?", "\n"), "\n[ \t]", "")
    parts = F.slice(F.split(text, r"(?im)^BEGIN:VEVENT[ \t]*$"), F.lit(2), F.lit(1 << 30))
    inner = F.transform(parts, lambda e: F.split(e, r"(?im)^END:VEVENT[ \t]*$", 2)[0])
    last = lambda e, name: F.try_element_at(F.regexp_extract_all(e, F.lit(rf"(?im)^{name}(?:;[^:\n]*)?:([^\n]*)$"), F.lit(1)), F.lit(-1))
    stamp = r"^\s*(\d{8})(?:T(\d{2})(\d{2})\d{2})?"
    events = F.transform(inner, lambda e, i: F.struct(i.cast("long").alias("src_seq"), last(e, "DTSTART").alias("_begin"), last(e, "DTEND").alias("_end"), last(e, "SUMMARY").alias("_title")))
    events = F.transform(events, lambda x: F.struct(x.alias("x"), parse_date(F.regexp_extract(x["_begin"], stamp, 1), "yyyyMMdd").alias("date")))
    # each event's texts are searched once: a condition on rows would be pushed down with copies of all searches
    fields = files.select("src_doc", F.explode(F.filter(events, lambda y: y["date"].isNotNull())).alias("y")).select("src_doc", "y.x.*", "y.date")
    clock = lambda v: F.when(F.regexp_extract(v, stamp, 2) != "", F.concat_ws(":", F.regexp_extract(v, stamp, 2), F.regexp_extract(v, stamp, 3)))
    title = F.replace(F.replace(F.col("_title"), F.lit("\\,"), F.lit(",")), F.lit("\\n"), F.lit(" "))
    out = fields.select("src_doc", "src_seq", "date", clock(F.col("_begin")).alias("start"), clock(F.col("_end")).alias("_stop"), F.coalesce(F.nullif(title, F.lit("")), F.lit("SHIFT")).alias("type"))
    return out.select(
        "src_doc", "src_seq", "date", F.date_format("date", "yyyy-MM").alias("ym"), "type", "start", F.when(F.col("start").isNotNull(), F.coalesce("_stop", "start")).alias("end"), F.col("start").isNull().alias("all_day"), F.lit(False).alias("is_validated")
    )


def lines_of(docs: DataFrame, key: str = "src_doc", text: str = "content") -> DataFrame:
    """(key, line_no, line): all lines of each text, no-break blanks made plain."""
    plain = F.replace(F.coalesce(F.col(text), F.lit("")), F.lit(" "), F.lit(" "))
    return docs.select(key, F.posexplode(F.split(plain, "\r?\n")).alias("line_no", "line"))


def landing(spark: SparkSession, path: str, fallback_ym: str) -> tuple[DataFrame, DataFrame]:
    """(artifacts, errors) of a landing folder: kind by suffix; a period from a
    name like 07-2026 or 2026-07, else the fallback; other files become error rows."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    kind = F.when(name.endswith(".pdf"), "pdf").when(name.endswith(".csv"), "csv").when(name.endswith(".ics"), "ics").when(name.rlike(r"\.(txt|text)$"), "text").when(name.rlike(r"\.(jpe?g|png|webp)$"), "image")
    own = F.coalesce(
        F.when(name.rlike(r"(?<!\d)(0[1-9]|1[0-2])-(20\d\d)(?!\d)"), F.regexp_replace(F.regexp_extract(name, r"(0[1-9]|1[0-2])-(20\d\d)", 0), r"(\d\d)-(\d{4})", "$2-$1")),
        F.nullif(F.regexp_extract(name, r"20\d\d-(?:0[1-9]|1[0-2])", 0), F.lit("")),
        F.lit(fallback_ym),
    )
    rows = files.select("path", "content", kind.alias("kind"), own.alias("ym"))
    return rows.where("kind IS NOT NULL"), rows.where("kind IS NULL").select("path", F.concat(F.lit("unsupported file: "), F.element_at(F.split("path", "/"), -1)).alias("reason"))


SOURCES: dict[str, Callable[..., DataFrame]] = {}
#: Old source names and the ones that they mean now.
RENAMED = {"file": "local-file", "files": "local-file", "photo": "camera"}
GROUPS = {"local-file": "import", "csv": "import", "ics": "import", "camera": "camera", "portal": "portal"}


def source(name: str) -> Callable:
    """Registers a source function under a name."""

    def add(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        SOURCES[name] = fn
        return fn

    return add


def require(name: str) -> Callable[..., DataFrame]:
    key = RENAMED.get(name, name)
    if key not in SOURCES:
        raise KeyError(f"no source {name}")
    return SOURCES[key]


def supported(allowed: Sequence[str] | None) -> list[str]:
    """Registered sources that a pack allows (all if it names none)."""
    return [s for s in SOURCES if allowed is None or s in allowed]


def groups_of(ids: Column) -> Column:
    """Distinct user-facing groups of source ids, by first place."""
    pairs = F.create_map(*[F.lit(x) for kv in GROUPS.items() for x in kv])
    return F.array_distinct(F.transform(ids, lambda i: F.coalesce(F.try_element_at(pairs, i), i)))


@source("csv")
def read_csv(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    return csv_shifts(whole_files(spark, paths))


@source("ics")
def read_ics(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    return calendar_shifts(whole_files(spark, paths))


def boxes(pages: DataFrame) -> DataFrame:
    """Positioned tokens of recognised pages (page_id, blocks: nested arrays of
    text and box): one row for each element, numbered within its page."""
    elements = F.flatten(F.flatten(F.transform("blocks", lambda b: F.transform(b["lines"], lambda x: x["elements"]))))
    return pages.select("page_id", F.posexplode(elements).alias("token_id", "e")).select("page_id", F.col("token_id").cast("long"), "e.text", "e.x", "e.y", "e.w", "e.h")


def union_box(tokens: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The box around each key's tokens, and its text from left to right."""
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "text"))), lambda t: t["text"]), " ")
    out = tokens.groupBy(*keys).agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("_r"), F.max(F.col("y") + F.col("h")).alias("_b"), words.alias("text"))
    return out.select(*keys, "text", "x", "y", (F.col("_r") - F.col("x")).alias("w"), (F.col("_b") - F.col("y")).alias("h"))


def ordered_within(df: DataFrame, keys: Sequence[str], order: Sequence, to: str = "src_seq") -> DataFrame:
    return df.withColumn(to, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))
