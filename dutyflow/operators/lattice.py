"""The ruled lines of a roster page as a regular lattice.

A line detector misses lines and finds false ones. For each page the pitch and
phase are searched that explain the detected lines best; the lattice is then
fitted to the lines it explains, clipped to what the page shows, and day headers
are attached to its columns. A page has a few dozen lines, so each page is one
array in an Arrow batch; pages are spread by Spark."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ship, spread

PAGE = "page_id"
#: A line is explained within this share of the pitch; a gap can hide so many lines.
TOLERANCE, HIDDEN = 0.12, 4
#: A header is attached to a column at most so many pitches away.
REACH = 1.35
LEAST_COLUMNS, LEAST_REGULAR = 3, 0.45


def fit(lines: np.ndarray, low: float, high: float) -> tuple[float, float, int, int] | None:
    """(first position, pitch, lines of the lattice, lines explained) of the
    lattice with a pitch in [low, high] that explains the detected lines best:
    explained lines count one, lattice lines between them that were not detected
    cost half a line, and so does a detected line that is not explained. Of
    equally good lattices the one with the widest pitch wins (its halves explain
    the same lines), then the leftmost."""
    x = np.unique(lines)
    n = len(x)
    if n < 2:
        return None
    # a line's next neighbours are enough: one gap between them is a pitch or hides few lines
    gap = np.concatenate([x[k:] - x[:-k] for k in range(1, min(HIDDEN, n - 1) + 1)])
    pitch = np.concatenate([gap / k for k in range(1, HIDDEN + 1)])
    pitch = np.sort(pitch[(pitch >= low) & (pitch <= high)])
    if not len(pitch):
        return None
    # pitches within a thousandth explain the same lines, and the fit below finds the exact one
    pitch = pitch[np.unique(np.round(np.log(pitch) * 1000), return_index=True)[1]]
    bound = _bounds(x, pitch)
    for least in (np.sort(bound)[-min(8, len(pitch))], None):  # the most promising pitches, then those that can be as good
        keep = bound >= (least if least is not None else best - 1e-6)
        best, found = _best(x, pitch[keep])
    hit, index = found
    for _ in range(3):  # least squares through the explained lines; they may be others after it
        k, at = index[hit], x[hit]
        if len(np.unique(k)) < 2:
            return None
        p, first = np.polyfit(k, at, 1)
        new = np.round((x - first) / p)
        keep = np.abs((x - first) / p - new) <= TOLERANCE
        if (keep == hit).all() and (new == index).all():
            break
        hit, index = keep, new
    lo, hi = index[hit].min(), index[hit].max()
    return float(first + lo * p), float(p), int(hi - lo + 1), int(len(np.unique(index[hit])))


def _bounds(x: np.ndarray, pitch: np.ndarray) -> np.ndarray:
    """What the score of each pitch cannot exceed: by the number of lines whose
    phase is near that of another one, and the least stretch so many lines take."""
    n = len(x)
    phase = ((x / pitch[:, None]) % 1.0).astype(np.float32)
    off = phase[:, None, :] - phase[:, :, None]
    near = (np.abs(off - np.rint(off)) <= np.float32(TOLERANCE + 1e-3)).sum(axis=2)
    stretch = np.array([0.0] + [(x[e - 1 :] - x[: n - e + 1]).min() for e in range(1, n + 1)])
    places = stretch[near] / pitch[:, None] + 1 - 2 * TOLERANCE - 1e-3
    return (np.minimum(near, 1.5 * near - 0.5 * places) - 0.5 * (n - near)).max(axis=1)


def _best(x: np.ndarray, pitch: np.ndarray) -> tuple[float, tuple[np.ndarray, np.ndarray]]:
    """(score, (which lines it explains, their places)) of the best lattice of these pitches."""
    n, pitch = len(x), pitch[:, None, None]
    index = (x[None, None, :] - x[None, :, None]) / pitch  # of each line, with each line as the first, for each pitch
    place = np.rint(index)
    hit = np.abs(index - place) <= TOLERANCE
    # lines are sorted, so places are: the place of the explained line before each is a running maximum
    upto = np.maximum.accumulate(np.where(hit, place, -np.inf), axis=2)
    own = (upto[:, :, 1:] > upto[:, :, :-1]).sum(axis=2) + hit[:, :, 0]
    explained = hit.sum(axis=2)
    first_hit = np.take_along_axis(place, hit.argmax(axis=2)[:, :, None], axis=2)[:, :, 0]
    score = own - 0.5 * (upto[:, :, -1] - first_hit + 1 - own) - 0.5 * (n - explained)
    best = score.max()
    k = int(np.flatnonzero((score >= best - 1e-9).any(axis=1))[-1])  # the widest pitch
    i = int(np.argmax(score[k]))
    return float(best), (hit[k, i], place[k, i])


def lattices(lines: DataFrame, low: float = 8.0, high: float = 200.0) -> DataFrame:
    """(page_id, first, pitch, count, seen) of every page with a lattice. lines:
    page_id, x; nulls and repeated lines say nothing."""
    ship(lines.sparkSession)

    @F.pandas_udf("struct<first:double,pitch:double,count:int,seen:int>")
    def run(arrays: pd.Series) -> pd.DataFrame:
        out = [fit(np.asarray(a, float), low, high) or (None,) * 4 for a in arrays]
        return pd.DataFrame(out, columns=["first", "pitch", "count", "seen"])

    pages = spread(lines.where("x IS NOT NULL"), PAGE).groupBy(PAGE).agg(F.collect_set(F.col("x").cast("double")).alias("xs"))
    run = run.asNondeterministic()  # else the filter below fits each lattice again
    return pages.select(PAGE, run("xs").alias("l")).select(PAGE, "l.*").where("pitch IS NOT NULL")


def clipped(found: DataFrame, content: DataFrame) -> DataFrame:
    """Lattices without the lines left or right of what a page shows (page_id,
    x_lo, x_hi), half a pitch allowed, and continued to its edges where lines
    are missing; pages without content stay as they are."""
    rows = found.join(content.hint("merge"), PAGE, "left")
    lo = F.coalesce(F.ceil((F.col("x_lo") - F.col("first")) / F.col("pitch") - 0.5), F.lit(0))
    hi = F.coalesce(F.floor((F.col("x_hi") - F.col("first")) / F.col("pitch") + 0.5), F.col("count") - 1)
    return rows.select(PAGE, (F.col("first") + lo * F.col("pitch")).alias("first"), "pitch", (hi - lo + 1).cast("int").alias("count"), "seen").where("count > 1")


def positions(found: DataFrame) -> DataFrame:
    """(page_id, idx, x): every line of the lattice, detected or not."""
    return found.select(PAGE, "first", "pitch", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("idx")).select(PAGE, "idx", (F.col("first") + F.col("idx") * F.col("pitch")).alias("x"))


def frames(found: DataFrame) -> DataFrame:
    """(page_id, col, x0, x1): the columns between neighbouring lines."""
    each = found.where("count > 1").select(PAGE, "first", "pitch", F.explode(F.sequence(F.lit(0), F.col("count") - 2)).alias("col"))
    return each.select(PAGE, "col", (F.col("first") + F.col("col") * F.col("pitch")).alias("x0"), (F.col("first") + (F.col("col") + 1) * F.col("pitch")).alias("x1"))


def quality(found: DataFrame, expected: Column | None = None) -> DataFrame:
    """(page_id, ok, reason, regularity): enough columns (two may lack of those
    expected), and lattice lines that were detected."""
    columns = F.col("count") - 1
    least = F.lit(LEAST_COLUMNS) if expected is None else F.greatest(F.lit(LEAST_COLUMNS), expected - 2)
    share = F.col("seen") / F.col("count")
    reason = F.when(columns < least, "too few columns").when(share < LEAST_REGULAR, "irregular lines")
    return found.select(PAGE, reason.isNull().alias("ok"), reason.alias("reason"), share.alias("regularity"))


def snap(headers: DataFrame, found: DataFrame) -> DataFrame:
    """(page_id, col, x, label): the whole strip of columns, each with the header
    that lies nearest to its middle. headers: page_id, x, label. A header belongs
    to the nearest column within REACH pitches; a column that gets none is called
    by its number from 1, so days that were not read keep an empty column."""
    # a page has a few dozen headers: they come as one array to the page's lattice, which is fitted once and never broadcast
    own = headers.groupBy(PAGE).agg(F.collect_list(F.struct("x", "label")).alias("heads")).hint("merge")
    page, last = found.where("count > 1").join(own, PAGE, "left"), F.col("count") - 2
    at = lambda h: (h["x"] - F.col("first")) / F.col("pitch") - 0.5
    col = lambda h: F.greatest(F.lit(0), F.least(last, F.round(at(h)).cast("int")))
    placed = F.transform("heads", lambda h: F.struct(col(h).alias("col"), F.abs(at(h) - col(h)).alias("off"), h["x"].alias("x"), h["label"].alias("label")))
    page = page.withColumn("heads", F.array_sort(F.filter(placed, lambda h: h["off"] <= REACH)))
    each = page.select(PAGE, "first", "pitch", "heads", F.explode(F.sequence(F.lit(0), last)).alias("col"))
    label = F.get(F.filter("heads", lambda h: h["col"] == F.col("col")), F.lit(0))["label"]  # the first of the column is the nearest
    x0, x1 = F.col("first") + F.col("col") * F.col("pitch"), F.col("first") + (F.col("col") + 1) * F.col("pitch")
    return each.select(PAGE, "col", ((x0 + x1) / 2).alias("x"), label.alias("label")).select(PAGE, "col", "x", F.coalesce("label", (F.col("col") + 1).cast("string")).alias("label"))


def covered(tokens: DataFrame, found: DataFrame) -> DataFrame:
    """Adds ``col``: the lattice column in which a token's middle (x + w / 2) lies, by arithmetic instead of a range join; null outside."""
    at = F.floor((F.col("x") + F.col("w") / 2 - F.col("first")) / F.col("pitch")).cast("int")
    rows = tokens.join(found.select(PAGE, "first", "pitch", "count"), PAGE, "left")
    return rows.withColumn("col", F.when((at >= 0) & (at < F.col("count") - 1), at)).drop("first", "pitch", "count")


def regular(rows: DataFrame, tolerance: float = 0.2) -> DataFrame:
    """(page_id, pitch, spread): the median gap of neighbouring positions and the share of gaps near it. rows: page_id, x."""
    step = F.col("x") - F.lag("x").over(Window.partitionBy(PAGE).orderBy("x"))
    gaps = rows.select(PAGE, step.alias("s")).where("s > 0")
    mid = gaps.groupBy(PAGE).agg(F.median("s").alias("pitch"))
    near = (F.abs(F.col("s") - F.col("pitch")) <= tolerance * F.col("pitch")).cast("double")
    return gaps.join(mid, PAGE).groupBy(PAGE, "pitch").agg(F.avg(near).alias("regularity"))
