"""Queries of layout scores and week strips over pages written from table rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classify, grid, layouts
from .bindings import bound
from .text_queries import CELL_SQL, PLACED_SQL, hour_rows, plain_grid, tokens, written


@bound(f"""
WITH {CELL_SQL}, g AS (SELECT page, count(DISTINCT user_id) AS n, count(*) FILTER (WHERE cell <> '') AS full_ FROM ce GROUP BY page),
s AS (SELECT page, least(1, 0.4 + 0.35 * CASE WHEN n = 5 THEN 0.8 WHEN n >= 2 THEN 0.55 ELSE 0.3 END + 0.25 * least(1, full_ / (n * 30) * 4)) AS built,
  CASE WHEN n >= 2 THEN least(0.85, 0.4 + 0.4 * CASE WHEN n = 5 THEN 0.8 ELSE 0.55 END + 0.2 * least(1, full_ / 40)) ELSE 0 END AS hinted FROM g)
SELECT page AS page_id, 'month' AS layout, round(greatest(built, hinted), 6) AS score FROM s""")
def page_layouts(spark, sf_dir):
    cells, seen = plain_grid(spark, sf_dir), tokens(spark, sf_dir)
    pages = cells.select("page_id").distinct().withColumn("text", F.lit(""))
    scores = layouts.layout_scores(pages, seen, grid.metrics(cells))
    return classify.choose_layout(scores, "page_id").select("page_id", "layout", F.round("score", 6).alias("score"))


#: Users with an even id: dated lines; others: a weekday and a clock.
@bound(f"""
WITH {PLACED_SQL}, n AS (SELECT user_id, count(*) AS n, count(DISTINCT d) AS dates, count(DISTINCT isodow(d)) AS days FROM p GROUP BY 1),
s AS (SELECT user_id, unnest(['month', 'week', 'date-duty', 'list', 'day-plan', 'calendar']) AS layout, unnest([0,
    CASE WHEN user_id % 2 = 0 OR days < 4 THEN 0 ELSE least(0.45, 0.18 + 0.05 * days) END, 0,
    CASE WHEN user_id % 2 = 1 THEN 0 WHEN n = 1 THEN 0.2 ELSE least(1, 0.35 + n / 12) END,
    CASE WHEN user_id % 2 = 1 THEN CASE WHEN n < 4 THEN 0 ELSE least(0.55, n / 16) + 0.2 END
      WHEN 2 * n < 4 OR dates > 3 THEN 0 ELSE least(0.55, 2 * n / 16) + CASE dates WHEN 1 THEN 0.2 WHEN 2 THEN 0.1 ELSE 0 END END, 0]) AS score FROM n)
SELECT 'u' || user_id AS page_id, layout, round(score, 6) AS score FROM s""")
def written_layouts(spark, sf_dir):
    dated = F.concat_ws(" ", F.date_format("date", "dd.MM.yyyy"), "event_type", F.concat("start", F.lit("-"), "end"))
    label = F.element_at(F.array(*[F.lit(d) for d in ("Mo", "Di", "Mi", "Do", "Fr", "Sa", "So")]), F.weekday("date") + 1)
    docs = written(hour_rows(spark, sf_dir), F.when(F.col("user_id") % 2 == 0, dated).otherwise(F.concat_ws(" ", label, "event_type", "start")))
    none = spark.createDataFrame([], "page_id string, text string, x double, y double, w double, h double")
    scores = layouts.layout_scores(docs.select(F.col("src_doc").alias("page_id"), F.col("content").alias("text")), none)
    return scores.select("page_id", "layout", F.round("score", 6).alias("score"))


@bound(f"""
WITH {CELL_SQL}, w AS (SELECT *, 4 + page[2:]::INT % 8 AS days FROM ce), k AS (SELECT page, days, count(DISTINCT user_id) AS n FROM w WHERE day <= days GROUP BY 1, 2)
SELECT k.page AS page_id, (w.user_id % 5)::INT AS row_idx, w.day, w.cell, k.days >= 5 AND n >= 2 AS week_sized FROM k JOIN w USING (page) WHERE k.days <= 9 AND w.day <= k.days""")
def week_strips(spark, sf_dir):
    cells = plain_grid(spark, sf_dir).where(F.col("day") <= 4 + F.substring("page_id", 2, 9).cast("int") % 8)
    kept, verdict = layouts.week_grids(cells)
    return kept.join(verdict, "page_id").select("page_id", "row_idx", "day", "cell", "week_sized")
