"""Positioned tokens of roster photos -> person x day grid in long form -> shifts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dates, numbers, text
from .lookups import best_overlap, small, times_of_codes
from .marts import slot_fits
from .sequences import fill_between, gap_clusters, interpolate, keep_first, midpoint_bands, vacation_runs

PAGE = "page_id"


def center(axis: str) -> Column:
    size = {"x": "w", "y": "h"}[axis]
    return F.col(axis) + F.col(size) / 2


def is_weekday(t: Column) -> Column:
    return t.rlike(r"(?i)^(Mo|Di|Mi|Do|Fr|Sa|So)\.?$")


def is_day_number(t: Column) -> Column:
    return t.rlike(r"^([1-9]|[12]\d|3[01])\.?$")


def is_clock(t: Column) -> Column:
    return t.rlike(r"^\d{1,2}[:.]?\d{2}([-–]\d{1,2}[:.]?\d{2})?$")


def is_cell(t: Column) -> Column:
    """Short tokens that can stand in a cell: codes, clocks, slashes."""
    return t.rlike(r"^(/{1,2}|-|[A-Za-zÄÖÜ][A-Za-zÄÖÜ0-9*+/]{0,6}|[0-9:.–-]{3,11})$") & ~is_weekday(t)


def focus(tokens: DataFrame, margin: float = 4.0) -> DataFrame:
    """Tokens inside the box around day headers, names and cells of each page."""
    inner = is_cell(F.trim("text")) | text.day_header(F.col("text"))["day"].isNotNull() | text.plausible_person(F.col("text"))
    page = Window.partitionBy(PAGE)
    side = lambda f, v: f(F.when(F.col("_inner"), v)).over(page)
    rows = tokens.withColumn("_inner", inner).withColumns({
        "_x0": side(F.min, F.col("x")), "_y0": side(F.min, F.col("y")), "_x1": side(F.max, F.col("x") + F.col("w")), "_y1": side(F.max, F.col("y") + F.col("h")),
    })
    inside = center("x").between(F.col("_x0") - margin, F.col("_x1") + margin) & center("y").between(F.col("_y0") - margin, F.col("_y1") + margin)
    return rows.where(inside).select(*tokens.columns)


def headers(tokens: DataFrame) -> DataFrame:
    """(page_id, day_idx, day, weekday, x_center, y_center): day columns of the
    densest header line; the first of tokens that name one day; days in rising order from left to right."""
    parsed = text.day_header(F.trim("text"))
    bare = F.when(is_day_number(F.trim("text")), F.regexp_replace(F.trim("text"), r"\D", "").cast("int"))
    page = Window.partitionBy(PAGE)
    rows = tokens.select(PAGE, F.coalesce(parsed["day"], bare).alias("day"), parsed["weekday"].alias("weekday"), center("x").alias("xc"), center("y").alias("yc"), "h").where("day IS NOT NULL")
    rows = gap_clusters(rows.withColumn("_h", F.median("h").over(page)), [PAGE], "yc", F.col("_h") * 0.8, "band", tie=["xc"])
    band = Window.partitionBy(PAGE, "band")
    rows = rows.withColumn("_n", F.size(F.collect_set("day").over(band))).withColumn("_y", F.min("yc").over(band))
    rows = rows.withColumn("_best", F.first("band").over(page.orderBy(F.desc("_n"), "_y"))).where("band = _best")
    rows = keep_first(rows, [PAGE, "day"], ["xc"])
    highest = F.max("day").over(page.orderBy("xc").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_high", highest).where("_high IS NULL OR day > _high")
    return rows.withColumn("day_idx", (F.row_number().over(page.orderBy("xc")) - 1).cast("int")).select(PAGE, "day_idx", "day", "weekday", F.col("xc").alias("x_center"), F.col("yc").alias("y_center"))


def complete_headers(found: DataFrame, month_days: Column | None = None) -> DataFrame:
    """All days from the first to the last found (or of the month), missing centres interpolated between neighbours."""
    known = F.map_from_entries(F.collect_list(F.struct("day", F.struct("weekday", "x_center"))))
    pages = found.groupBy(PAGE).agg(F.min("day").alias("a"), F.max("day").alias("b"), F.avg("y_center").alias("y_center"), known.alias("_known"))
    last = F.col("b") if month_days is None else F.least(F.greatest(F.col("b"), month_days), F.lit(31))
    rows = pages.select(PAGE, "y_center", "_known", F.explode(F.sequence("a", last)).alias("day")).withColumn("_k", F.try_element_at("_known", F.col("day")))
    rows = rows.select(PAGE, "y_center", "day", F.col("_k.weekday").alias("weekday"), F.col("_k.x_center").alias("x_center"))
    rows = interpolate(rows, [PAGE], "day", "x_center", "x_center").where("x_center IS NOT NULL")
    return rows.withColumn("day_idx", (F.row_number().over(Window.partitionBy(PAGE).orderBy("day")) - 1).cast("int"))


def columns(found: DataFrame) -> DataFrame:
    """Day columns with borders half way to their neighbours: page_id, day_idx, day, x0, x1."""
    return midpoint_bands(found, [PAGE], "x_center", "x0", "x1").select(PAGE, "day_idx", "day", "x0", "x1")


def skew(found: DataFrame) -> DataFrame:
    """(page_id, slope, x_ref): least squares through the header tokens, refitted without those more than two residual deviations off."""
    page = Window.partitionBy(PAGE)
    fit = found.withColumn("_s", F.regr_slope("y_center", "x_center").over(page)).withColumn("_i", F.regr_intercept("y_center", "x_center").over(page))
    rows = fit.withColumn("r", F.abs(F.col("y_center") - F.col("_i") - F.col("_s") * F.col("x_center")))
    rows = rows.withColumn("d", F.stddev_pop("r").over(page)).withColumn("m", F.avg("r").over(page))
    kept = rows.where(F.col("r") <= F.col("m") + 2 * F.col("d") + 1e-9)
    return kept.groupBy(PAGE).agg(F.coalesce(F.regr_slope("y_center", "x_center"), F.lit(0.0)).alias("slope"), F.min("x_center").alias("x_ref"))


def level(tokens: DataFrame, slopes: DataFrame) -> DataFrame:
    """Adds ``yl``: the vertical centre with the skew taken out; pages without a slope are level."""
    slope, ref = F.coalesce("slope", F.lit(0.0)), F.coalesce("x_ref", F.lit(0.0))
    return tokens.join(slopes, PAGE, "left").withColumn("yl", center("y") - slope * (center("x") - ref)).drop("slope", "x_ref")


def divider(found: DataFrame, names: DataFrame) -> DataFrame:
    """(page_id, x_div): the border of the name column, between the names' right edge and the first day column."""
    first = found.groupBy(PAGE).agg(F.min("x_center").alias("_day"))
    edge = names.groupBy(PAGE).agg(F.max(F.col("x") + F.col("w")).alias("_edge"))
    return first.join(edge, PAGE, "left").select(PAGE, F.when(F.col("_edge") < F.col("_day"), (F.col("_edge") + F.col("_day")) / 2).otherwise(F.col("_day") * 0.95).alias("x_div"))


def people(tokens: DataFrame, borders: DataFrame) -> DataFrame:
    """(page_id, row_idx, person, y_center): name tokens left of the divider, joined on one line, top to bottom. tokens: with yl."""
    rows = tokens.join(borders, PAGE).where((center("x") < F.col("x_div")) & F.col("text").rlike("[A-Za-zÄÖÜäöü]{2,}"))
    rows = gap_clusters(rows.withColumn("_h", F.median("h").over(Window.partitionBy(PAGE))), [PAGE], "yl", F.col("_h") * 0.6, "row", tie=["x"])
    label = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "text"))), lambda t: t["text"]), " ")
    named = rows.groupBy(PAGE, "row").agg(label.alias("person"), F.avg("yl").alias("y_center")).where(text.plausible_person(F.col("person")))
    return named.withColumn("row_idx", (F.row_number().over(Window.partitionBy(PAGE).orderBy("y_center")) - 1).cast("int")).select(PAGE, "row_idx", "person", "y_center")


def bands(rows: DataFrame) -> DataFrame:
    return midpoint_bands(rows, [PAGE], "y_center", "y_lo", "y_hi")


def bands_from_lines(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """Bands of people between ruled lines: the nearest line above and below each name; without one the midpoint stays. lines: page_id, y."""
    marks = rows.select(PAGE, F.col("y_center").alias("y"), "row_idx").unionByName(lines.select(PAGE, "y", F.lit(None).cast("int").alias("row_idx")))
    line = F.when(F.col("row_idx").isNull(), F.col("y"))
    w = Window.partitionBy(PAGE).orderBy("y")
    marks = marks.withColumn("_a", F.last(line, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_b", F.first(line, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    found = marks.where("row_idx IS NOT NULL").select(PAGE, "row_idx", "_a", "_b")
    return bands(rows).join(found, [PAGE, "row_idx"]).withColumn("y_lo", F.coalesce("_a", "y_lo")).withColumn("y_hi", F.coalesce("_b", "y_hi")).drop("_a", "_b")


def disjoint(rows: DataFrame) -> DataFrame:
    """(page_id, disjoint): no band reaches into the next one."""
    after = F.lead("y_lo").over(Window.partitionBy(PAGE).orderBy("y_lo"))
    return rows.withColumn("_n", after).groupBy(PAGE).agg(F.bool_and(F.coalesce(F.col("_n") >= F.col("y_hi") - 1e-6, F.lit(True))).alias("disjoint"))


def build(tokens: DataFrame) -> DataFrame:
    """The grid of each page: page_id, row_idx, person, day_idx, day, cell.

    Tokens meet the columns by largest overlap and the people by level band;
    a page has a few dozen of each, so joins on the page stay small. What
    several steps read (tokens in focus, headers, level tokens) is persisted, so
    it is planned and computed once; ``spark.catalog.clearCache()`` frees it."""
    inner = focus(tokens).persist()
    found = headers(inner).persist()
    cols = columns(complete_headers(found))
    flat = level(inner, skew(found)).persist()
    named = flat.where(text.plausible_person(F.col("text")))
    borders = divider(found, named)
    rows = bands(people(flat, borders)).persist()
    top = found.groupBy(PAGE).agg(F.max("y_center").alias("_top"))
    cells = flat.join(borders, PAGE).join(top, PAGE).where((center("x") >= F.col("x_div")) & (center("y") > F.col("_top")) & is_cell(F.trim("text"))).drop("x_div", "_top")
    placed = best_overlap(cells, cols, PAGE, "token_id")
    placed = placed.join(rows.select(PAGE, "row_idx", "person", "y_lo", "y_hi"), PAGE).where((F.col("yl") >= F.col("y_lo")) & (F.col("yl") < F.col("y_hi")))
    joined = placed.groupBy(PAGE, "row_idx", "day_idx").agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("yl", "x", "text"))), lambda t: F.trim(t["text"]))), "+").alias("cell"))
    spine = rows.select(PAGE, "row_idx", "person").join(cols.select(PAGE, "day_idx", "day"), PAGE)
    return spine.join(joined, [PAGE, "row_idx", "day_idx"], "left").select(PAGE, "row_idx", "person", "day_idx", "day", F.coalesce("cell", F.lit("")).alias("cell"))


def metrics(grid: DataFrame) -> DataFrame:
    """Columns, people, filled share and distinct days of each page."""
    return grid.groupBy(PAGE).agg(F.count_distinct("day_idx").alias("columns"), F.count_distinct("row_idx").alias("people"), F.avg((F.col("cell") != "").cast("double")).alias("filled"), F.count_distinct("day").alias("days"))


def usable(grid: DataFrame, columns_: int = 5, people_: int = 1, filled: float = 0.05) -> DataFrame:
    """(page_id, ok, reason): the first thing that a grid lacks."""
    reason = F.when(F.col("columns") < columns_, "too few days").when(F.col("people") < people_, "no people").when(F.col("filled") < filled, "almost empty")
    return metrics(grid).select(PAGE, reason.isNull().alias("ok"), reason.alias("reason"))


def seed_by_ink(grid: DataFrame, hints: DataFrame) -> DataFrame:
    """Empty cells with much dark ink become vacation, cells that a slash crosses are cleared; hints: page_id, row_idx, day_idx, dark, slash."""
    rows = grid.join(hints, [PAGE, "row_idx", "day_idx"], "left")
    crossed = (F.col("slash") >= 0.35) & (F.col("slash") > F.col("dark") + 0.08) & (F.col("dark") < 0.30)
    cell = F.when((F.col("dark") >= 0.70) & (F.col("cell") == ""), "U").when(crossed & (F.col("cell") == "U"), "/").otherwise(F.col("cell"))
    return rows.withColumn("cell", cell).drop("dark", "slash")


def finish_vacation(grid: DataFrame, ym: Column, hits: DataFrame | None = None, code: str = "U") -> DataFrame:
    """Vacation cells: recognised hits, then empty cells between two vacation days, then long empty runs from a weekend on."""
    rows = grid
    if hits is not None:
        rows = rows.join(hits.select(PAGE, "row_idx", "day_idx", F.lit(True).alias("_hit")), [PAGE, "row_idx", "day_idx"], "left").withColumn("cell", F.when(F.col("_hit") & (F.col("cell") == ""), code).otherwise(F.col("cell"))).drop("_hit")
    keys = [PAGE, "row_idx"]
    rows = fill_between(rows, keys, ["day_idx"], F.col("cell") == code, (F.col("cell") != "") & (F.col("cell") != code), "_in")
    rows = rows.withColumn("cell", F.when(F.col("_in"), code).otherwise(F.col("cell"))).withColumn("_date", dates.parse_date(F.concat(ym, F.lit("-"), F.lpad(F.col("day").cast("string"), 2, "0"))))
    rows = vacation_runs(rows, keys, "_date", F.col("cell") == "")
    return rows.withColumn("cell", F.when(F.col("vacation"), code).otherwise(F.col("cell"))).drop("_in", "_date", "vacation")


def clamp_to_clusters(grid: DataFrame, code: str = "U", gap: int = 2, reach: int = 1) -> DataFrame:
    """Vacation cells further than ``reach`` days from a cluster of two or more seeds are cleared."""
    keys = [PAGE, "row_idx"]
    seeds = gap_clusters(grid.where(F.col("cell") == code), keys, "day_idx", gap, "c")
    spans = seeds.groupBy(*keys, "c").agg(F.min("day_idx").alias("_a"), F.max("day_idx").alias("_b"), F.count("*").alias("_n")).where("_n > 1")
    inside = grid.join(spans, keys).where((F.col("day_idx") >= F.col("_a") - reach) & (F.col("day_idx") <= F.col("_b") + reach)).select(*keys, "day_idx").distinct().withColumn("_ok", F.lit(True))
    out = grid.join(inside, [*keys, "day_idx"], "left")
    return out.withColumn("cell", F.when((F.col("cell") == code) & F.col("_ok").isNull(), "").otherwise(F.col("cell"))).drop("_ok")


def merged_person(grid: DataFrame, people: DataFrame | Sequence[str]) -> DataFrame:
    """(page_id, day_idx, day, cell): the cells of all rows of the named people
    (name keys; a table of any size has them in ``key``), distinct, joined in row order."""
    key, full = text.name_key(F.col("person")), grid.where(F.trim("cell") != "")
    if isinstance(people, DataFrame):
        mine = full.withColumn("_key", key).join(small(people.select(F.col("key").alias("_key")).distinct()), "_key", "left_semi")
    else:
        mine = full.where(key.isin(*people))
    joined = F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "cell"))), lambda c: F.trim(c["cell"]))), "+")
    return mine.groupBy(PAGE, "day_idx", "day").agg(joined.alias("cell"))


def to_shifts(cells: DataFrame, codes: DataFrame, ym: Column, slots: DataFrame | None = None) -> DataFrame:
    """Unpivoted cells -> shifts: a row for each duty of a cell, with the cell's
    own times, else a duty column's time on that day, else the code table's,
    else all day. Impossible dates are left out."""
    rows = cells.withColumn("date", dates.parse_date(F.concat(ym, F.lit("-"), F.lpad(F.col("day").cast("string"), 2, "0")))).where("date IS NOT NULL")
    rows = rows.select(PAGE, "date", F.posexplode(text.duty_cell(F.col("cell"))).alias("src_seq", "d")).select(PAGE, "date", F.col("src_seq").cast("long"), F.col("d.short").alias("type"), F.col("d.start").alias("_s"), F.col("d.end").alias("_e"))
    rows = times_of_codes(rows, codes, "type")
    if slots is not None:
        days = rows.select("date", "type").distinct().join(small(slots.select("code", F.struct("ord", "when", "start", "end").alias("_slot"))), F.col("type") == F.col("code"))
        fits, general = slot_fits(F.col("_slot.when"), F.col("date")), (F.col("_slot.when") == "any").cast("int")
        per = days.where(fits).groupBy("date", "type").agg(F.min_by("_slot", F.struct(general.alias("r"), F.col("_slot.ord").alias("o"))).alias("_slot"))
        rows = rows.join(per.select("date", "type", F.col("_slot.start").alias("_ss"), F.col("_slot.end").alias("_se")), ["date", "type"], "left")
    else:
        rows = rows.withColumn("_ss", F.lit(None).cast("string")).withColumn("_se", F.lit(None).cast("string"))
    start, end = F.coalesce("_s", "_ss", "rule_start"), F.coalesce("_e", "_se", "rule_end")
    both = start.isNotNull() & end.isNotNull()
    return rows.select(PAGE, "date", F.date_format("date", "yyyy-MM").alias("ym"), "src_seq", "type", F.when(both, start).alias("start"), F.when(both, end).alias("end"), (~both).alias("all_day"))


def patch(grid: DataFrame, keys: Sequence[str], day: int, cell: str) -> DataFrame:
    """One cell of all rows of the named people."""
    hit = text.name_key(F.col("person")).isin(*keys) & (F.col("day") == day)
    return grid.withColumn("cell", F.when(hit, F.lit(cell)).otherwise(F.col("cell")))


def as_text(grid: DataFrame, width: int = 6) -> DataFrame:
    """(page_id, row_idx, line): a person's row as padded text."""
    cells = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("day_idx", "cell"))), lambda c: F.rpad(c["cell"], width, " ")), "")
    return grid.groupBy(PAGE, "row_idx", "person").agg(F.rtrim(F.concat(F.rpad("person", 24, " "), cells)).alias("line")).select(PAGE, "row_idx", "line")


def merge_passes(first: DataFrame, second: DataFrame, dx: float = 32.0, dy: float = 24.0) -> DataFrame:
    """Tokens of both passes: short tokens of the second that no near token of
    the first (or an earlier one of the second) says already. Positions meet in
    cells of 2 dx x 2 dy: what is near a token lies in four of them at most."""
    short = second.where(F.length(F.trim("text")).between(1, 6))
    place = lambda df: df.withColumn("_cx", center("x")).withColumn("_cy", center("y"))
    cell = lambda c, size: F.floor(c / (2 * size))
    span = lambda c, d: F.sequence(cell(F.col(c) - d, d), cell(F.col(c) + d, d))
    every = place(first.withColumn("_pass", F.lit(1)).unionByName(short.withColumn("_pass", F.lit(2))))
    other = every.select(PAGE, cell(F.col("_cx"), dx).alias("_bx"), cell(F.col("_cy"), dy).alias("_by"), F.col("_cx").alias("_ox"), F.col("_cy").alias("_oy"), F.col("text").alias("_ot"), F.col("_pass").alias("_op"), F.col("token_id").alias("_oid"))
    look = every.where("_pass = 2").select(PAGE, "token_id", "text", "_cx", "_cy", F.explode(span("_cx", dx)).alias("_bx"), F.col("_cy").alias("_y")).withColumn("_by", F.explode(span("_y", dy)))
    pairs = look.join(other, [PAGE, "_bx", "_by"])
    earlier = (F.col("_op") == 1) | (F.col("_oid") < F.col("token_id"))
    says = (F.lower("_ot") == F.lower("text")) | F.col("_ot").contains(F.col("text")) | F.col("text").contains(F.col("_ot"))
    seen = pairs.where(earlier & says & (F.abs(F.col("_cx") - F.col("_ox")) <= dx) & (F.abs(F.col("_cy") - F.col("_oy")) <= dy)).select(PAGE, "token_id").distinct()
    return first.unionByName(short.join(seen, [PAGE, "token_id"], "left_anti"))


def date_duty_to_people(assignments: DataFrame) -> DataFrame:
    """Date x duty plans (page_id, date, duty, person) as person x day grid in long form."""
    rows = assignments.groupBy(PAGE, "person", F.dayofmonth("date").alias("day")).agg(F.array_join(F.array_sort(F.collect_set("duty")), "+").alias("cell"))
    numbered = rows.select(PAGE, "person").distinct().withColumn("row_idx", (F.row_number().over(Window.partitionBy(PAGE).orderBy("person")) - 1).cast("int"))
    return rows.join(numbered, [PAGE, "person"]).select(PAGE, "row_idx", "person", (F.col("day") - 1).alias("day_idx"), "day", "cell")


def duty_columns(phrases: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Header phrases -> duty column by needles: all of ``all_of``, one of ``any_of``; the better quality, then order, wins."""
    v = small(vocabulary)
    low = F.lower("phrase")
    fits = F.forall(F.coalesce("all_of", F.array().cast("array<string>")), lambda n: low.contains(n)) & ((F.size(F.coalesce("any_of", F.array().cast("array<string>"))) == 0) | F.exists("any_of", lambda n: low.contains(n)))
    rows = phrases.join(v, fits)
    return keep_first(rows, phrases.columns, [F.desc("quality"), "ord"]).select(*phrases.columns, "short")


def regular_lattice(lines: DataFrame, tolerance: float = 0.2) -> DataFrame:
    """Ruled lines with the median pitch: those of the longest regular run of each page. lines: page_id, y."""
    from .sequences import longest_regular_run

    step = F.col("y") - F.lag("y").over(Window.partitionBy(PAGE).orderBy("y"))
    pitch = lines.withColumn("_s", step).groupBy(PAGE).agg(F.median("_s").alias("pitch"))
    rows = lines.join(pitch, PAGE).withColumn("_tol", F.col("pitch") * tolerance)
    return longest_regular_run(rows, [PAGE], "y", "pitch", F.col("_tol")).drop("_tol")


def weekend(date: Column, label: Column) -> Column:
    """By calendar, else by the header label."""
    return F.coalesce(F.weekday(date) >= 5, label.rlike("(?i)^(Sa|So)"))


def spread(values: Column) -> Column:
    """Coefficient of variation."""
    return F.stddev_pop(values) / F.nullif(F.avg(values), F.lit(0.0))


def box_score(grid_box: Sequence[Column], truth: Sequence[Column]) -> Column:
    return numbers.box_overlap(*grid_box, *truth)
