"""Boxes that a user painted on a page: which tokens lie in them, and the grid of
a painted row.

Points meet boxes through a grid of cells with several levels: a box is put
where cells are an eighth of its size, so it covers 17 x 17 cells at most, and a
point looks into one cell of each level that has boxes. The join is an equi-join
on (page, level, cell), so neither a large box nor a crowded page makes a
nested loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dates, text
from ..session import spread
from .sequences import gap_clusters

PAGE = "page_id"
#: Cells are halved so often from the unit square; smaller boxes share the last level.
LEVELS = 12
#: Levels below the one whose cells are as large as the box: a crowded page is cut finer, and most points of a cell are inside.
FINER = 3
# fixed values: margins around painted boxes, in shares of the page
MARGINS = {"name-column": (0.02, 0.04), "day-header": (0.02, 0.03), "own-row": (0.02, 0.02)}
ROW_MARGIN = (0.01, 0.015)


def _level(w: Column, h: Column) -> Column:
    """FINER levels below the finest one whose cells are as large as the box."""
    size = F.greatest(w, h, F.lit(2.0**-LEVELS))
    return F.least(F.greatest(F.floor(-F.log2(size)), F.lit(0)) + F.when(size <= 1, FINER).otherwise(0), F.lit(LEVELS)).cast("int")


def _cell(value: Column, level: Column) -> Column:
    return F.floor(value * F.pow(F.lit(2.0), level)).cast("long")


def inside(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Points (page_id, px, py, ...) with each box (page_id, x, y, w, h, ...) that
    holds them, edges included. All are in shares of the page; boxes may reach
    beyond it, points and boxes with nulls meet nothing."""
    own = [c for c in boxes.columns if c != PAGE]
    put = boxes.where((F.col("x") + F.col("y")).isNotNull() & (F.col("w") >= 0) & (F.col("h") >= 0)).withColumn("_l", _level(F.col("w"), F.col("h")))
    span = lambda at, size: F.sequence(_cell(F.col(at), F.col("_l")), _cell(F.col(at) + F.col(size), F.col("_l")))
    put = put.withColumn("_cx", F.explode(span("x", "w"))).withColumn("_cy", F.explode(span("y", "h")))
    levels = put.groupBy(PAGE).agg(F.collect_set("_l").alias("_levels"))
    look = points.join(levels, PAGE).withColumn("_l", F.explode("_levels")).withColumn("_cx", _cell(F.col("px"), F.col("_l"))).withColumn("_cy", _cell(F.col("py"), F.col("_l")))
    named = put.select(PAGE, "_l", "_cx", "_cy", *[F.col(c).alias(f"_b_{c}") for c in own])
    hit = F.col("px").between(F.col("_b_x"), F.col("_b_x") + F.col("_b_w")) & F.col("py").between(F.col("_b_y"), F.col("_b_y") + F.col("_b_h"))
    cell = [PAGE, "_l", "_cx", "_cy"]  # few rows in, many out: neither side is broadcast and no partitions are joined
    return spread(look, *cell).join(spread(named, *cell).hint("shuffle_hash"), cell).where(hit).select(*points.columns, *[F.col(f"_b_{c}").alias(f"box_{c}") for c in own])


def _shares(tokens: DataFrame, pages: DataFrame) -> DataFrame:
    """Tokens with their centres px, py in shares of the page (pages: page_id, width, height)."""
    rows = tokens.join(pages.where("width > 0 AND height > 0").select(PAGE, "width", "height"), PAGE)
    return rows.withColumn("px", (F.col("x") + F.col("w") / 2) / F.col("width")).withColumn("py", (F.col("y") + F.col("h") / 2) / F.col("height"))


def _wider(regions: DataFrame, margin_x: Column, margin_y: Column) -> DataFrame:
    """The boxes with margins, cut at the page's edges."""
    x, y = F.greatest(F.lit(0.0), F.col("x") - margin_x), F.greatest(F.lit(0.0), F.col("y") - margin_y)
    right, bottom = F.least(F.lit(1.0), F.col("x") + F.col("w") + margin_x), F.least(F.lit(1.0), F.col("y") + F.col("h") + margin_y)
    return regions.select(PAGE, "kind", x.alias("x"), y.alias("y"), F.greatest(F.lit(0.01), right - x).alias("w"), F.greatest(F.lit(0.01), bottom - y).alias("h"))


def of_kind(regions: DataFrame, kind: str) -> DataFrame:
    """The first box of a kind on each page (ord)."""
    return regions.where(F.col("kind") == kind).groupBy(PAGE).agg(F.min_by(F.struct("x", "y", "w", "h"), "ord").alias("b")).select(PAGE, F.lit(kind).alias("kind"), "b.*")


def support(tokens: DataFrame, regions: DataFrame, pages: DataFrame) -> DataFrame:
    """The tokens that a grid is rebuilt from: those in the painted name column,
    day header or own row (with margins), and, if both of the first are painted,
    those in the table below the header. Pages without a painted box keep all.

    regions: page_id, ord, kind, x, y, w, h in shares; tokens: with token_id."""
    known = regions.where(F.col("kind").isin(*MARGINS))
    firsts = [of_kind(known, kind) for kind in MARGINS]
    margin = lambda i: F.element_at(F.create_map(*[F.lit(v) for k, m in MARGINS.items() for v in (k, m[i])]), F.col("kind"))
    boxes = _wider(firsts[0].unionByName(firsts[1]).unionByName(firsts[2]), margin(0), margin(1))
    head = firsts[1].select(PAGE, *[F.col(c).alias(f"_{c}") for c in "xywh"])
    left, top = F.least("x", "_x"), F.col("_y") + F.col("_h") * 0.5
    right = F.greatest(F.col("x") + F.col("w"), F.col("_x") + F.col("_w"))
    body = firsts[0].join(head, PAGE).select(PAGE, F.lit("body").alias("kind"), left.alias("x"), top.alias("y"), F.greatest(F.lit(0.05), right - left).alias("w"), F.greatest(F.lit(0.05), 1 - top).alias("h"))
    found = inside(_shares(tokens, pages).select(PAGE, "token_id", "px", "py"), boxes.unionByName(body)).select(PAGE, "token_id").distinct()
    painted = regions.select(PAGE).distinct()
    return tokens.join(found, [PAGE, "token_id"], "left_semi").unionByName(tokens.join(painted, PAGE, "left_anti"))


def own_row(tokens: DataFrame, regions: DataFrame, pages: DataFrame, ym: str, name: str | None = None) -> DataFrame:
    """The grid of the painted own row: page_id, row_idx, person, day_idx, day, cell.

    Tokens right of the name column are grouped by gaps (over 0.55 of the median
    gap, eight pixels at least) and stand for the days of the month from the
    first on, no more than it has. The person is ``name``, else the tokens in the
    name column, else 'Ich'; a page without a token in its row gives no rows."""
    row, column = of_kind(regions, "own-row"), of_kind(regions, "name-column")
    wide = _wider(row, F.lit(ROW_MARGIN[0]), F.lit(ROW_MARGIN[1]))
    edge = row.join(column.select(PAGE, (F.col("x") + F.col("w")).alias("_name")), PAGE, "left")
    edge = edge.select(PAGE, F.coalesce("_name", F.least(F.lit(0.28), F.col("x") + F.greatest(F.lit(0.12), F.col("w") * 0.22))).alias("_edge"))
    rows = inside(_shares(tokens, pages), wide).select(*tokens.columns, "px", "width").join(edge, PAGE).withColumn("_t", F.trim("text"))
    words = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda t: t["_t"]), " ")
    people = rows.groupBy(PAGE).agg(words(F.when(F.col("px") < F.col("_edge"), F.struct("x", "_t"))).alias("_own"), F.first("width").alias("_width"))
    person = F.coalesce(F.nullif(F.trim(F.lit(name)), F.lit("")), F.nullif("_own", F.lit("")), F.lit("Ich"))
    cells = rows.where((F.col("px") >= F.col("_edge") * 0.92) & (F.col("_t") != "") & text.day_header(F.col("_t"))["day"].isNull()).withColumn("_at", F.col("px") * F.col("width"))
    step = F.col("_at") - F.lag("_at").over(Window.partitionBy(PAGE).orderBy("_at", "token_id"))
    gaps = cells.withColumn("_s", step).groupBy(PAGE).agg(F.median(F.when(F.col("_s") > 4, F.col("_s"))).alias("_gap"))
    near = cells.join(gaps, PAGE).withColumn("_gap", F.greatest(F.lit(8.0), 0.55 * F.coalesce("_gap", F.col("width") / 32)))
    grouped = gap_clusters(near, [PAGE], "_at", F.col("_gap"), "_group", tie=["token_id"])
    joined = grouped.groupBy(PAGE, "_group").agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("_at", "token_id", "_t"))), lambda t: t["_t"])), "+").alias("cell"))
    days = joined.withColumn("day", F.row_number().over(Window.partitionBy(PAGE).orderBy("_group"))).where(F.col("day") <= F.dayofmonth(F.last_day(F.lit(f"{ym}-01").cast("date"))))
    return days.join(people, PAGE).select(PAGE, F.lit(0).alias("row_idx"), person.alias("person"), (F.col("day") - 1).alias("day_idx"), "day", "cell")


def header_labels(grid: DataFrame, ym: str) -> DataFrame:
    """Adds ``label``: weekday and number of each day, as a header would show it."""
    date = F.make_date(F.lit(int(ym[:4])), F.lit(int(ym[5:])), F.col("day"))
    return grid.withColumn("label", F.concat(dates.weekday_label(date), F.col("day").cast("string")))
