"""Operators on ordered rows: context, clusters, islands, fills, first-wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BEFORE = (Window.unboundedPreceding, Window.currentRow)
AFTER = (Window.currentRow, Window.unboundedFollowing)


def _over(keys: Sequence[str], order: Sequence[Column | str]) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def carry_forward(df: DataFrame, keys: Sequence[str], order: Sequence, value: str, to: str) -> DataFrame:
    """Adds ``to``: the last non-null ``value`` up to each row."""
    return df.withColumn(to, F.last(value, ignorenulls=True).over(_over(keys, order).rowsBetween(*BEFORE)))


def section_flag(df: DataFrame, keys: Sequence[str], order: Sequence, opens: Column, closes: Column, to: str) -> DataFrame:
    """Adds ``to``: whether the last opening or closing line up to each row opened the section."""
    mark = F.when(closes, F.lit(False)).when(opens, F.lit(True))
    return df.withColumn(to, F.coalesce(F.last(mark, ignorenulls=True).over(_over(keys, order).rowsBetween(*BEFORE)), F.lit(False)))


def segments(df: DataFrame, keys: Sequence[str], order: Sequence, value: str, to: str) -> DataFrame:
    """Adds ``to``: a number that grows whenever ``value`` changes."""
    w = _over(keys, order)
    new = ~F.col(value).eqNullSafe(F.lag(value).over(w)) | F.row_number().over(w).eqNullSafe(1)
    return df.withColumn("_new", new.cast("int")).withColumn(to, F.sum("_new").over(w.rowsBetween(*BEFORE))).drop("_new")


def gap_clusters(df: DataFrame, keys: Sequence[str], value: str, gap: float | Column, to: str, tie: Sequence = ()) -> DataFrame:
    """Adds ``to``: cluster number from 1; a new one starts where the distance to the value before is above ``gap``."""
    w = _over(keys, [value, *tie])
    new = F.coalesce((F.col(value) - F.lag(value).over(w) > gap).cast("int"), F.lit(0))
    return df.withColumn("_new", new).withColumn(to, F.sum("_new").over(w.rowsBetween(*BEFORE)) + 1).drop("_new")


def islands(df: DataFrame, keys: Sequence[str], order: Sequence, flag: Column) -> DataFrame:
    """Maximal runs of rows with ``flag`` : adds island (its number among the keys' runs), island_size and island_place; null elsewhere."""
    w = _over(keys, order)
    out = df.withColumn("_in", F.coalesce(flag, F.lit(False)))
    out = out.withColumn("_start", (F.col("_in") & ~F.coalesce(F.lag("_in").over(w), F.lit(False))).cast("int"))
    out = out.withColumn("island", F.when(F.col("_in"), F.sum("_start").over(w.rowsBetween(*BEFORE))))
    inside = Window.partitionBy(*keys, "island")
    return out.withColumn("island_size", F.when(F.col("_in"), F.count("*").over(inside))).withColumn("island_place", F.when(F.col("_in"), F.row_number().over(inside.orderBy(*order)))).drop("_in", "_start")


def vacation_runs(df: DataFrame, keys: Sequence[str], day: str, empty: Column, least: int = 7) -> DataFrame:
    """Adds ``vacation``: the day lies in an empty run of ``least`` days or more that begins on a weekend."""
    out = islands(df, keys, [day], empty)
    first = F.first(F.weekday(day)).over(Window.partitionBy(*keys, "island").orderBy(day))
    return out.withColumn("vacation", F.coalesce((F.col("island_size") >= least) & (first >= 5), F.lit(False))).drop("island", "island_size", "island_place")


def flood_fill(df: DataFrame, keys: Sequence[str], order: Sequence, seed: Column, blocker: Column, to: str) -> DataFrame:
    """Adds ``to``: a seed, or reached from one on either side before any blocker."""
    mark = F.when(seed, F.lit("s")).when(blocker, F.lit("b"))
    w = _over(keys, order)
    left = F.last(mark, ignorenulls=True).over(w.rowsBetween(*BEFORE))
    right = F.first(mark, ignorenulls=True).over(w.rowsBetween(*AFTER))
    return df.withColumn("_mark", mark).withColumn(to, F.coalesce(F.when(F.col("_mark") == "b", False), (left == "s") | (right == "s"), F.lit(False))).drop("_mark")


def fill_between(df: DataFrame, keys: Sequence[str], order: Sequence, seed: Column, blocker: Column, to: str) -> DataFrame:
    """Adds ``to``: a seed, or seeds on both sides with no blocker in between."""
    mark = F.when(seed, F.lit("s")).when(blocker, F.lit("b"))
    w = _over(keys, order)
    left = F.last(mark, ignorenulls=True).over(w.rowsBetween(*BEFORE))
    right = F.first(mark, ignorenulls=True).over(w.rowsBetween(*AFTER))
    return df.withColumn(to, F.coalesce((left == "s") & (right == "s"), F.lit(False)))


def interpolate(df: DataFrame, keys: Sequence[str], position: str, value: str, to: str) -> DataFrame:
    """Adds ``to``: missing values between two known ones, linear in ``position``."""
    w = _over(keys, [position])
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(position).alias("p"), F.col(value).alias("v")))
    low, high = F.last(known, ignorenulls=True).over(w.rowsBetween(*BEFORE)), F.first(known, ignorenulls=True).over(w.rowsBetween(*AFTER))
    out = df.withColumn("_a", low).withColumn("_b", high)
    line = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * (F.col(position) - F.col("_a.p")) / F.nullif(F.col("_b.p") - F.col("_a.p"), F.lit(0))
    return out.withColumn(to, F.coalesce(F.col(value), line)).drop("_a", "_b")


def midpoint_bands(df: DataFrame, keys: Sequence[str], center: str, low: str = "band_low", high: str = "band_high") -> DataFrame:
    """Adds the borders half way to the neighbours; the outer borders lie as far out as the inner ones."""
    w = _over(keys, [center])
    before, after = F.lag(center).over(w), F.lead(center).over(w)
    c = F.col(center)
    return df.withColumn(low, F.coalesce((c + before) / 2, c - (after - c) / 2, c)).withColumn(high, F.coalesce((c + after) / 2, c + (c - before) / 2, c))


def longest_regular_run(df: DataFrame, keys: Sequence[str], position: str, pitch: str, tolerance: float) -> DataFrame:
    """The rows of each key's longest run of positions whose steps differ from ``pitch`` by ``tolerance`` at most; the first wins ties."""
    w = _over(keys, [position])
    step = F.abs(F.col(position) - F.lag(position).over(w) - F.col(pitch)) > tolerance
    out = df.withColumn("_new", F.coalesce(step, F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(w.rowsBetween(*BEFORE)))
    out = out.withColumn("_size", F.count("*").over(Window.partitionBy(*keys, "_run")))
    best = F.first("_run").over(Window.partitionBy(*keys).orderBy(F.desc("_size"), "_run"))
    return out.withColumn("_best", best).where("_run = _best").drop("_new", "_run", "_size", "_best")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """The first row of each key in the given (total) order."""
    return df.withColumn("_n", F.row_number().over(_over(keys, order))).where("_n = 1").drop("_n")


def first_by_rank(df: DataFrame, keys: Sequence[str], order: Sequence, most: int) -> DataFrame:
    """The first ``most`` rows of each key."""
    return df.withColumn("_n", F.row_number().over(_over(keys, order))).where(F.col("_n") <= most).drop("_n")


def mode_first(df: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """(keys, value, n): the most frequent value; of equally frequent ones the one that came first."""
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    return keep_first(counted, keys, [F.desc("n"), "_first"]).drop("_first")


def drop_repeats(df: DataFrame, keys: Sequence[str], order: Sequence, value: str) -> DataFrame:
    """Without rows whose value equals that of the row before."""
    before = F.lag(value).over(_over(keys, order))
    return df.withColumn("_same", F.col(value).eqNullSafe(before) & F.col(value).isNotNull()).where("NOT _same").drop("_same")


def best_and_second(df: DataFrame, keys: Sequence[str], score: str, order: str) -> DataFrame:
    """(keys, best, second, gap) of the scores; order breaks ties."""
    ranked = first_by_rank(df, keys, [F.desc(score), order], 2).withColumn("_n", F.row_number().over(_over(keys, [F.desc(score), order])))
    out = ranked.groupBy(*keys).agg(F.max(F.when(F.col("_n") == 1, F.col(score))).alias("best"), F.max(F.when(F.col("_n") == 2, F.col(score))).alias("second"))
    return out.withColumn("gap", F.col("best") - F.coalesce("second", F.lit(0.0)))
