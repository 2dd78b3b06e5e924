"""How much a page looks like each layout (month or week grid, date x duty board,
list, day plan, calendar), as aggregates of its tokens and expressions of its text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .grid import PAGE, center, metrics

# fixed values: weekday labels, dates and clocks as they stand on rosters
DAYS = "Mo|Di|Mi|Do|Fr|Sa|So"
DATE = r"\b\d{1,2}[./]\d{1,2}(?:[./]\d{2,4})?\b"
CLOCK = r"\b\d{1,2}:\d{2}\b"
LEFT_DATE = rf"(?i)^\d{{1,2}}[./]\d{{1,2}}([./]\d{{2,4}})?\s*[,.]?\s*({DAYS})?\.?\s*[,.]?$"
DAY_HEADER = rf"(?i)^(({DAYS})\s*\d{{1,2}}|\d{{1,2}}\s*({DAYS}))$"
CLOCK_CELL = r"^\d{1,2}[:.]\d{2}(-\d{1,2}[:.]\d{2})?$"
CODE_CELL = r"^([A-ZÄÖÜ]{1,3}\d{1,2}|[A-ZÄÖÜ]{1,2}|[A-ZÄÖÜ]{2,3}-[A-ZÄÖÜ0-9]{1,3})$"
ENTRY_LINE = r"(?iu)\b\d{1,2}[./-]\d{1,2}(?:[./-]\d{2,4})?\b.*(?:\b\d{1,2}:\d{2}\b|\b[A-ZÄÖÜ]{1,5}\b)"
WEEKDAY_MARK = rf"(?i)(?:{DAYS}|Mon|Tue|Wed|Thu|Fri|Sat|Sun)(?=[0-9]|\b)"
#: Titles of day plans and calendars, word by word.
DAY_TITLES = ("tag plan", "tages plan", "daily plan", "day roster")
CALENDAR_TITLES = ("einzelkalender", "mein kalender", "monatskalender", "my calendar", "personal calendar")
MONTH_NAME = (
    r"(?iu)\b(januar|februar|märz|maerz|april|mai|juni|juli|august|september|oktober|november|dezember"
    r"|january|february|march|may|june|july|october|december)\b"
)
# fixed values: weights and steps of the scores. Steps are (least, value), highest first, with the value below them
MONTH = {"columns": (0.4, ((20, 1.0), (10, 0.75), (7, 0.45)), 0.25), "people": (0.35, ((10, 1.0), (5, 0.8), (2, 0.55)), 0.3), "filled": (0.25, 0.25)}
HINTS = {"width": 0.4, "names": (0.4, ((10, 1.0), (5, 0.8), (2, 0.55)), 0.0), "cells": (0.2, 40), "most": 0.85, "signal": 7, "least_names": 2}
WIDTHS = (((20, 24, None), 1.0), ((10, 14, None), 0.75), ((7, None, 10), 0.55))  # (headers, numbers or signal at least), value
NARROW, BOARD_DAMP, LEFT_DAMP, PACK_DAMP = 0.35, 0.2, 0.45, 0.75
WEEK = {"grid": 0.55, "day": 0.06, "people": (16, 0.3), "text": (0.18, 0.05, 0.45), "least_days": 4, "dates_below": 12}
DUTY = {"dates": (28, 0.45), "duties": (4, 0.4), "left": (8, 0.12), "top": (2, 0.04, 0.18), "board": 0.15, "marker": 0.08, "strip": (10, 0.3), "people": (6, 0.4)}
DAY_PLAN = {"title": 0.35, "clock": 0.05, "few": 0.4, "clocks": (16, 0.55), "one_date": 0.2, "two_dates": 0.1}
CALENDAR = {"title": 0.4, "month": 0.15, "days": ((28, 0.45), (20, 0.35), (10, 0.2))}
#: Layouts in the order in which the first of equal scores wins.
LAYOUTS = ("month", "week", "date-duty", "list", "day-plan", "calendar")


def steps(x: Column, table: Sequence[tuple[float, float]], otherwise: float) -> Column:
    """The value of the highest step (least, value) that x reaches; steps fall."""
    out = F.lit(otherwise)
    for least, value in reversed(table):
        out = F.when(x >= least, F.lit(value)).otherwise(out)
    return out


def titled(x: Column, titles: Sequence[str]) -> Column:
    """Whether one of the titles stands in the text, its words together or apart."""
    one = "|".join(r"\s*".join(t.split()) for t in titles)
    return x.rlike(rf"(?i)\b(?:{one})\b")


def weighted(x: Column, rule: tuple) -> Column:
    """weight * step of x, for a rule (weight, steps, value below)."""
    weight, table, below = rule
    return weight * steps(x, table, below)


def within(x: Column, most: float = 1.0) -> Column:
    return F.greatest(F.least(x, F.lit(most)), F.lit(0.0))


def plain(x: Column) -> Column:
    """Words of a header for comparison: no accents, lower case, one space between."""
    low = F.translate(F.lower(F.coalesce(x, F.lit(""))), "äöüàáâéèêëíìîïóòôúùûçñ", "aouaaaeeeeiiiiooouuucn")
    return F.trim(F.regexp_replace(low, "[^a-z0-9]+", " "))


def token_kind(t: Column) -> Column:
    """'header', 'weekday', 'number', 'cell' or 'other' of a trimmed token."""
    tight = F.replace(t, F.lit(" "), F.lit(""))
    code = (F.length(tight) <= 6) & ~tight.rlike(rf"(?i)^({DAYS})\d*$") & ~t.rlike("^[A-ZÄÖÜ][a-zäöüß]{2,}") & (F.upper(tight).rlike(CODE_CELL) | tight.rlike("^[A-ZÄÖÜ]{3}$"))
    digits = F.length(F.regexp_replace(t, r"\D", "")).between(3, 8)
    cell = (F.length(t) <= 28) & (code | t.rlike(CLOCK_CELL) | t.rlike(r"(?i)^[a-z]?:?\d{2}$") | digits)
    number = t.rlike(r"^\d{1,2}$") & t.try_cast("int").between(1, 31)
    return F.when(t.rlike(DAY_HEADER), "header").when(t.rlike(rf"(?i)^({DAYS})$"), "weekday").when(number, "number").when(cell, "cell").otherwise("other")


def _needle(header: Column, needle: str) -> Column:
    """A needle of digits must be the header's last word; any other may stand anywhere."""
    return F.concat(F.lit(" "), header).endswith(f" {needle}") if needle.isdigit() else header.contains(needle)


def names_duty(header: Column, duties: Sequence[tuple[str, Sequence[str], bool]]) -> Column:
    """Whether plain() text of a header names one of (duty, needles, all of them)."""
    out = F.lit(False)
    for _, needles, every in duties:
        hits = [_needle(header, n) for n in needles]
        if hits:
            one = hits[0]
            for h in hits[1:]:
                one = one & h if every else one | h
            out = out | one
    return out & F.length(header).between(1, 48)


def cues(tokens: DataFrame, duties: Sequence[tuple[str, Sequence[str], bool]] = ()) -> DataFrame:
    """Counts of each page's tokens by kind and place; tokens: page_id, text, x, y, w, h.

    The page's width and height are those that its tokens reach. One shuffle by page."""
    page = Window.partitionBy(PAGE)
    t = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    sized = tokens.select(PAGE, t.alias("t"), center("x").alias("xc"), center("y").alias("yc"), F.max(F.col("x") + F.col("w")).over(page).alias("_w"), F.max(F.col("y") + F.col("h")).over(page).alias("_h"))
    rows = sized.withColumn("kind", token_kind(F.col("t"))).withColumn("_date", F.col("t").rlike(LEFT_DATE)).withColumn("_duty", names_duty(plain(F.col("t")), duties))
    named = (F.col("kind") == "other") & (F.length("t") >= 3) & F.col("t").rlike("[A-Za-zÄÖÜäöüß]") & ~F.col("t").rlike(r"\d") & (F.col("xc") < 0.3 * F.col("_w"))
    kind = lambda k: F.count_if(F.col("kind") == k)
    return rows.groupBy(PAGE).agg(
        kind("header").alias("headers"), kind("weekday").alias("weekdays"), kind("number").alias("numbers"), kind("cell").alias("cells"), F.count_if(named).alias("names"),
        F.count_if("_date").alias("dates"), F.count_if(F.col("_date") & (F.col("xc") < 0.28 * F.col("_w"))).alias("left_dates"),
        F.count_if("_duty").alias("duty_headers"), F.count_if(F.col("_duty") & (F.col("yc") <= 0.14 * F.col("_h"))).alias("top_duties"), F.count_if(F.col("t").rlike(r"^\d{1,2}$")).alias("two_digits"),
    )


def _of(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def _is_board() -> Column:
    """Dates at the left and no day headers: dates x duties, not people x days."""
    return (_of("left_dates") >= 8) & (_of("headers") < 6)


def month_score(pack_has_duties: bool = False) -> Column:
    """The better of the grid that was built and of token hints, less where the left side holds dates."""
    cols, people = _of("columns"), _of("people")
    share, full = MONTH["filled"]
    built = weighted(cols, MONTH["columns"]) + weighted(people, MONTH["people"]) + share * within(_of("filled") / full)
    built = F.when((cols >= 3) & (people >= 1), within(built)).otherwise(0.0)
    heads, numbers, names = _of("headers"), _of("numbers"), _of("names")
    signal = heads + F.least(_of("weekdays"), F.lit(7)) + F.when(numbers >= 10, F.least(numbers / 2, F.lit(14.0))).otherwise(0.0)
    width = F.lit(NARROW)
    for (by_heads, by_numbers, by_signal), value in reversed(WIDTHS):
        enough = heads >= by_heads
        for have, least in ((numbers, by_numbers), (signal, by_signal)):
            enough = enough if least is None else enough | (have >= least)
        width = F.when(enough, F.lit(value)).otherwise(width)
    cell_weight, many = HINTS["cells"]
    hints = within(HINTS["width"] * width + weighted(names, HINTS["names"]) + cell_weight * within(_of("cells") / many), HINTS["most"])
    best = F.greatest(built, F.when((signal >= HINTS["signal"]) & (names >= HINTS["least_names"]), hints).otherwise(0.0))
    damp = F.when(_is_board(), BOARD_DAMP).when((_of("left_dates") >= 6) & (heads < 8), LEFT_DAMP).otherwise(1.0)
    return within(best * damp * (F.when(_of("left_dates") >= 8, PACK_DAMP).otherwise(1.0) if pack_has_duties else F.lit(1.0)))


def is_week(columns: Column, people: Column) -> Column:
    """A grid of five to nine days with two people or more."""
    return columns.between(5, 9) & (people >= 2)


def week_score(x: Column) -> Column:
    days = F.size(F.array_distinct(F.transform(F.regexp_extract_all(x, F.lit(WEEKDAY_MARK), F.lit(0)), lambda d: F.lower(F.substring(d, 1, 2)))))
    (crowd, most), (base, each, cap) = WEEK["people"], WEEK["text"]
    grid = within(WEEK["grid"] + days * WEEK["day"] + F.least(_of("people") / crowd, F.lit(most)))
    score = F.when(is_week(_of("columns"), _of("people")), grid).otherwise(F.least(base + days * each, F.lit(cap)))
    return F.when((days >= WEEK["least_days"]) & (F.regexp_count(x, F.lit(DATE)) < WEEK["dates_below"]), score).otherwise(0.0)


def date_duty_score(x: Column, duties: Sequence[tuple[str, Sequence[str], bool]], markers: Sequence[str] = ()) -> Column:
    """Dates at the left and duties at the top; 0 if a pack names no duties."""
    if not duties:
        return F.lit(0.0)
    whole = plain(x)
    hits = sum((_needle(whole, n).cast("int") if n.isdigit() else whole.contains(n).cast("int") for _, needles, _ in duties for n in needles), F.lit(0))
    heads, left, top = _of("duty_headers"), _of("left_dates"), _of("top_duties")
    dates = F.greatest(F.size(F.array_distinct(F.regexp_extract_all(x, F.lit(DATE), F.lit(0)))), _of("dates"), left)
    (month, most_dates), (fewest, most_duties), (lefts, left_bonus), (tops, each_top, most_top) = DUTY["dates"], DUTY["duties"], DUTY["left"], DUTY["top"]
    score = F.least(dates / month, F.lit(most_dates)) + F.least((hits + heads) / float(max(fewest, len(duties))), F.lit(most_duties))
    score += F.when(left >= lefts, left_bonus).otherwise(0.0) + F.when(top >= tops, F.least(top * each_top, F.lit(most_top))).otherwise(0.0)
    score += F.when(_is_board() & ((heads >= 2) | (hits >= 2)), DUTY["board"]).otherwise(0.0)
    if markers:
        score += F.when(F.exists(F.array(*[F.lit(f"(?i){m}") for m in markers]), lambda m: F.regexp(x, m)), DUTY["marker"]).otherwise(0.0)
    strip = F.regexp_count(x, F.lit(rf"(?i)\b(?:{DAYS})\s*\d{{1,2}}\b"))
    people = F.regexp_count(x, F.lit(r"[A-ZÄÖÜ][A-Za-zÄÖÜäöüß\-']{2,},\s*[A-ZÄÖÜ]"))
    (long, strip_damp), (crowd, people_damp) = DUTY["strip"], DUTY["people"]
    score = score * F.when((_of("headers") >= long) | (strip >= long), strip_damp).otherwise(1.0) * F.when((people >= crowd) & (dates < 10) & (left < 6), people_damp).otherwise(1.0)
    return F.when((dates < 8) & (hits < 2) & (heads < 2), 0.0).otherwise(within(score))


def list_score(x: Column) -> Column:
    """Lines with a date and a clock or a code."""
    hits = F.size(F.filter(F.split(x, "\n"), lambda line: F.regexp(line, F.lit(ENTRY_LINE))))
    return F.when(hits >= 2, within(0.35 + hits / 12)).when(hits == 1, 0.2).otherwise(0.0)


def day_plan_score(x: Column) -> Column:
    """Many clocks and hardly a date."""
    title = F.when(titled(x, DAY_TITLES), DAY_PLAN["title"]).otherwise(0.0)
    clocks = F.regexp_count(x, F.lit(CLOCK))
    dates = F.size(F.array_distinct(F.regexp_extract_all(x, F.lit(rf"{DATE}|\b\d{{4}}-\d{{2}}-\d{{2}}\b"), F.lit(0))))
    few = F.when(title > 0, F.least(title + clocks * DAY_PLAN["clock"], F.lit(DAY_PLAN["few"]))).otherwise(0.0)
    full, most = DAY_PLAN["clocks"]
    many = within(title + F.least(clocks / full, F.lit(most)) + F.when(dates <= 1, DAY_PLAN["one_date"]).when(dates == 2, DAY_PLAN["two_dates"]).otherwise(0.0))
    return F.when(clocks < 4, few).when(dates > 3, 0.0).otherwise(many)


def calendar_score(x: Column) -> Column:
    """A calendar's title, a month's name and many day numbers."""
    title, month = F.when(titled(x, CALENDAR_TITLES), CALENDAR["title"]).otherwise(0.0), F.when(x.rlike(MONTH_NAME), CALENDAR["month"]).otherwise(0.0)
    days = _of("two_digits")
    return F.when((F.trim(x) == "") | ((days < 10) & (title == 0)), 0.0).otherwise(within(title + month + steps(days, CALENDAR["days"], 0.0)))


def layout_scores(pages: DataFrame, tokens: DataFrame, grids: DataFrame | None = None, duties: Sequence[tuple[str, Sequence[str], bool]] = (), markers: Sequence[str] = ()) -> DataFrame:
    """(page_id, layout, ord, score) of every page (page_id, text) and layout, for classify.choose_layout.

    ``grids`` are grid.metrics() of the grids that could be built; ``duties`` and
    ``markers`` come from the pack. Pages without tokens or a grid count 0 there."""
    rows = pages.select(PAGE, F.coalesce("text", F.lit("")).alias("_text")).join(cues(tokens, duties), PAGE, "left")
    if grids is None:
        rows = rows.withColumns({"columns": F.lit(0), "people": F.lit(0), "filled": F.lit(0.0)})
    else:
        rows = rows.join(grids.select(PAGE, "columns", "people", "filled"), PAGE, "left")
    x = F.col("_text")
    scores = (month_score(bool(duties)), week_score(x), date_duty_score(x, duties, markers), list_score(x), day_plan_score(x), calendar_score(x))
    each = F.array(*[F.struct(F.lit(name).alias("layout"), F.lit(i).alias("ord"), s.cast("double").alias("score")) for i, (name, s) in enumerate(zip(LAYOUTS, scores, strict=True))])
    return rows.select(PAGE, F.explode(each).alias("s")).select(PAGE, "s.*")


def week_grids(cells: DataFrame, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Week strips out of grid cells: the cells of pages with at most ``most`` day
    columns, and (page_id, ok, reason, week_sized) of every page."""
    sizes = metrics(cells)
    wide = F.col("columns") > most
    verdict = sizes.select(PAGE, (~wide).alias("ok"), F.when(wide, "too many days for a week").alias("reason"), is_week(F.col("columns"), F.col("people")).alias("week_sized"))
    return cells.join(sizes.where(~wide).select(PAGE), PAGE, "left_semi"), verdict
