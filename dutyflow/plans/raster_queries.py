"""Queries of rasters and painted boxes: cells and pages are drawn from table
rows, and each SQL says what was drawn."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import glyphs, images, regions
from ..session import ship, spread
from .bindings import bound, table
from .roster_queries import KIND_SQL, as_page, kinds

WIDTH, HEIGHT = 26, 32
STROKES = {
    "U": [((7, 7), (7, 21)), ((7, 21), (9, 24)), ((9, 24), (16, 24)), ((16, 24), (18, 21)), ((18, 21), (18, 7))], "/": [((19, 6), (6, 26))], "F": [((8, 6), (8, 25)), ((8, 6), (18, 6)), ((8, 15), (16, 15))],
    "O": [((8, 8), (17, 8)), ((17, 8), (17, 24)), ((17, 24), (8, 24)), ((8, 24), (8, 8))], "": [],
}
PAPER, INK = 230, 60


@lru_cache(1024)
def drawn(code: str, stroke: int, tilt: float, light: bool) -> bytes:
    """A cell with the strokes of a code, turned by ``tilt`` degrees about its middle."""
    y, x = np.mgrid[0:HEIGHT, 0:WIDTH].astype(float)
    a, cx, cy = math.radians(tilt), WIDTH / 2, HEIGHT / 2
    u, v = (x - cx) * math.cos(a) + (y - cy) * math.sin(a) + cx, (y - cy) * math.cos(a) - (x - cx) * math.sin(a) + cy
    out = np.zeros((HEIGHT, WIDTH), bool)
    for (x0, y0), (x1, y1) in STROKES[code]:
        dx, dy = x1 - x0, y1 - y0
        t = np.clip(((u - x0) * dx + (v - y0) * dy) / (dx * dx + dy * dy), 0, 1)
        out |= np.hypot(u - x0 - t * dx, v - y0 - t * dy) <= stroke / 2
    paper, ink = (INK, PAPER) if light else (PAPER, INK)
    return np.where(out, ink, paper).astype(np.uint8).tobytes()


def drawn_cells(spark, sf_dir) -> DataFrame:
    ship(spark)

    @F.pandas_udf("binary")
    def draw(code: pd.Series, stroke: pd.Series, tilt: pd.Series, light: pd.Series) -> pd.Series:
        return pd.Series([drawn(*x) for x in zip(code, stroke, tilt, light, strict=True)])

    u, d, kind = F.col("user_id"), F.col("day"), F.col("kind")
    code = F.when(kind == "purchase", "U").when(kind == "error", "/").when(kind == "click", "F").when(kind == "signup", "O").otherwise("")
    rows = spread(as_page(kinds(spark, sf_dir)), "page_id", "row_idx", "day_idx").select("page_id", "row_idx", "day_idx", code.alias("code"), (F.lit(2) + (u + d) % 2).alias("stroke"), ((u * 7 + d) % 5 * 3 - 6).cast("double").alias("tilt"), ((u + d) % 3 == 0).alias("light"))
    return rows.select("page_id", "row_idx", "day_idx", F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"), draw("code", "stroke", "tilt", "light").alias("pixels"))


GLYPH_SQL = "CASE kind WHEN 'purchase' THEN 'U' WHEN 'error' THEN '/' END"


@bound(f"WITH {KIND_SQL} SELECT 'r' || user_id // 5 AS page_id, (user_id % 5)::INT AS row_idx, day - 1 AS day_idx, {GLYPH_SQL} AS glyph FROM k")
def short_glyphs(spark, sf_dir):
    return glyphs.marks(drawn_cells(spark, sf_dir))


@bound(f"""WITH {KIND_SQL}, g AS (SELECT *, {GLYPH_SQL} AS glyph FROM k)
SELECT 'r' || user_id // 5 AS page_id, (user_id % 5)::INT AS row_idx, day - 1 AS day_idx, glyph, CASE WHEN glyph IS NOT NULL THEN CASE WHEN (user_id + day) % 3 = 0 THEN 2 ELSE 1 END END::INT AS pass FROM g""")
def second_readings(spark, sf_dir):
    return glyphs.both_readings(drawn_cells(spark, sf_dir))


PAGE_W, PAGE_H, PHOTO_W, PHOTO_H = 120, 90, 160, 130


@bound("""
WITH b AS (SELECT s_suppkey, c::INT AS c, r::INT AS r FROM supplier, range(0, 6) a(c), range(0, 4) d(r))
SELECT s_suppkey AS page_id, string_agg(CASE WHEN (s_suppkey * 31 + c * 7 + r * 13) % 3 = 0 THEN '1' ELSE '0' END, '' ORDER BY r, c) AS bits FROM b GROUP BY s_suppkey""")
def rectified_pages(spark, sf_dir):
    """Pages with dark squares, photographed at an angle on a dark ground, and read after they are set straight."""
    ship(spark)

    @F.pandas_udf("binary")
    def photo(keys: pd.Series) -> pd.Series:
        out = []
        for k in keys:
            page = np.full((PAGE_H, PAGE_W), 240, np.uint8)
            for c in range(6):
                for r in range(4):
                    if (k * 31 + c * 7 + r * 13) % 3 == 0:
                        page[r * 22 + 7 : r * 22 + 19, c * 19 + 8 : c * 19 + 18] = 40
            quad = [(10 + k % 7, 8 + k % 5), (148 - k % 6, 12 + k % 4), (150 - k % 5, 118 - k % 6), (8 + k % 4, 120 - k % 7)]
            corners = [(0, 0), (PAGE_W - 1, 0), (PAGE_W - 1, PAGE_H - 1), (0, PAGE_H - 1)]
            out.append(images.warp(page, images.homography(quad, corners), (PHOTO_H, PHOTO_W), paper=20).tobytes())
        return pd.Series(out)

    @F.pandas_udf("string")
    def squares(pixels: pd.Series) -> pd.Series:
        read = lambda g: "".join("1" if g[r * 22 + 10 : r * 22 + 16, c * 19 + 11 : c * 19 + 15].mean() < 128 else "0" for r in range(4) for c in range(6))
        return pixels.map(lambda p: read(np.frombuffer(p, np.uint8).reshape(PAGE_H, PAGE_W)))

    pages = spread(table(spark, sf_dir, "supplier"), "s_suppkey").select(F.col("s_suppkey").alias("page_id"), F.lit(PHOTO_W).alias("width"), F.lit(PHOTO_H).alias("height"), photo("s_suppkey").alias("pixels"))
    return images.rectified(pages, PAGE_W, PAGE_H).select("page_id", squares("pixels").alias("bits"))


@bound("""
WITH p AS (SELECT c_nationkey AS page_id, c_custkey AS point, (c_custkey * 37 % 1000) / 1000.0::DOUBLE AS px, (c_custkey * 91 % 997) / 997.0::DOUBLE AS py FROM customer),
b AS (SELECT s_nationkey AS page_id, s_suppkey AS box, (s_suppkey * 13 % 800) / 1000.0::DOUBLE AS x, (s_suppkey * 29 % 700) / 1000.0::DOUBLE AS y, (s_suppkey % 7) / 20.0::DOUBLE AS w, (s_suppkey % 11) / 30.0::DOUBLE AS h FROM supplier)
SELECT page_id, point, box FROM p JOIN b USING (page_id) WHERE px BETWEEN x AND x + w AND py BETWEEN y AND y + h""")
def points_in_boxes(spark, sf_dir):
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    points = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("page_id"), c.alias("point"), (c * 37 % 1000 / F.lit(1000.0)).alias("px"), (c * 91 % 997 / F.lit(997.0)).alias("py"))
    boxes = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("page_id"), s.alias("box"), (s * 13 % 800 / F.lit(1000.0)).alias("x"), (s * 29 % 700 / F.lit(1000.0)).alias("y"), (s % 7 / F.lit(20.0)).alias("w"), (s % 11 / F.lit(30.0)).alias("h"))
    return regions.inside(points, boxes).select("page_id", "point", F.col("box_box").alias("box"))


def painted_pages(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tokens, regions, pages): a page for each supplier with a name, a row of
    days of which every fifth has two codes, a header, and tokens elsewhere."""
    k = F.col("s_suppkey")
    base = table(spark, sf_dir, "supplier").select(k.alias("page_id"))
    key = F.col("page_id")
    days = base.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(27))))
    code = F.element_at(F.array(*[F.lit(c) for c in "FNSG"]), ((key + F.col("i")) % 4 + 1).cast("int"))
    token = lambda df, t, x, y: df.select("page_id", t.alias("text"), x.cast("double").alias("x"), y.cast("double").alias("y"), F.lit(4.0).alias("w"), F.lit(10.0).alias("h"))
    cells = token(days, code, 250 + 25 * F.col("i"), F.lit(330.0))
    second = token(days.where("i % 5 = 4"), F.lit("RD"), 256 + 25 * F.col("i"), F.lit(330.0))
    name = token(base, F.concat(F.lit("Muster"), key), F.lit(60.0), F.lit(330.0))
    head = token(days, F.concat(F.lit("Mo"), F.col("i") + 1), 250 + 25 * F.col("i"), F.lit(45.0))
    note = token(base, F.lit("Aushang"), F.lit(500.0), F.lit(5.0))
    tokens = cells.unionByName(second).unionByName(name).unionByName(head).unionByName(note).withColumn("token_id", F.xxhash64("page_id", "x", "y", "text"))
    box = lambda df, o, kind, x, y, w, h: df.select("page_id", F.lit(o).alias("ord"), F.lit(kind).alias("kind"), *[F.lit(v).alias(c) for c, v in zip("xywh", (x, y, w, h), strict=True)])
    painted = box(base, 0, "name-column", 0.05, 0.3, 0.15, 0.5).unionByName(box(base, 1, "own-row", 0.05, 0.4, 0.94, 0.03)).unionByName(box(base.where("page_id % 3 = 0"), 2, "day-header", 0.2, 0.05, 0.79, 0.02))
    return tokens, painted, base.select("page_id", F.lit(1000.0).alias("width"), F.lit(800.0).alias("height"))


@bound("""
WITH d AS (SELECT s_suppkey AS k, i::INT AS i FROM supplier, range(0, 28) r(i))
SELECT k AS page_id, 'Muster' || k AS person, i + 1 AS day, ['F','N','S','G'][(k + i) % 4 + 1] || CASE WHEN i % 5 = 4 THEN '+RD' ELSE '' END AS cell FROM d""")
def own_row_cells(spark, sf_dir):
    return regions.own_row(*painted_pages(spark, sf_dir), "2024-02").select("page_id", "person", "day", "cell")


@bound("""
WITH d AS (SELECT s_suppkey AS k, i::INT AS i FROM supplier, range(0, 28) r(i)), t AS (SELECT k, 'Muster' || k AS text FROM d WHERE i = 0 UNION ALL SELECT k, ['F','N','S','G'][(k + i) % 4 + 1] FROM d UNION ALL SELECT k, 'RD' FROM d WHERE i % 5 = 4
  UNION ALL SELECT k, 'Mo' || (i + 1) FROM d WHERE k % 3 = 0)
SELECT k AS page_id, text, count(*)::BIGINT AS n FROM t GROUP BY 1, 2""")
def painted_support(spark, sf_dir):
    return regions.support(*painted_pages(spark, sf_dir)).groupBy("page_id", "text").agg(F.count("*").alias("n"))


def ruled_rasters(spark, sf_dir) -> DataFrame:
    """Pages (a page for each supplier) with dark lines: 3 to 9 rows and a number of columns by key."""
    ship(spark)

    @F.pandas_udf("binary")
    def draw(rows: pd.Series, columns: pd.Series) -> pd.Series:
        out = []
        for r, c in zip(rows, columns, strict=True):
            page = np.full((20 + 12 * r, 20 + 9 * c), 255, np.uint8)
            page[10 : 10 + 12 * r : 12, 10:-10] = 0
            page[10:-10, 10 : 10 + 9 * c : 9] = 0
            out.append(page.tobytes())
        return pd.Series(out)

    k = F.col("s_suppkey")
    size = spread(table(spark, sf_dir, "supplier"), "s_suppkey").select(k.alias("page_id"), (k % 5 + 8).cast("int").alias("r"), F.when(k % 3 == 0, 28).when(k % 3 == 1, 8).otherwise(4).alias("c"))
    return size.select("page_id", (20 + 9 * F.col("c")).alias("width"), (20 + 12 * F.col("r")).alias("height"), draw("r", "c").alias("pixels"))


@bound("""SELECT s_suppkey AS page_id, CASE s_suppkey % 3 WHEN 0 THEN 'month' WHEN 1 THEN 'week' ELSE 'list' END AS layout, 0.0::DOUBLE AS skew FROM supplier""")
def raster_layouts(spark, sf_dir):
    return images.layout_of(images.page_metrics(ruled_rasters(spark, sf_dir)), "skew")
