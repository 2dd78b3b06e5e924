"""Short marks in roster cells: found as connected components, told by their shape.

A cell's raster is cut into ink and paper whichever of them is darker; the
largest component (union-find over runs of ink) is described by holes, by how
often scan lines cross it and by the slope of its pixels. No mark depends on
size, stroke or small tilts. Cells that a first reading leaves empty and whose
paper is dark are enhanced (contrast to their surroundings, strokes widened by
running maxima) and read again, in the same pass over the cells."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .images import local_contrast, once

CELL = ["page_id", "row_idx", "day_idx"]
#: Least contrast of ink and paper, shares of a cell that ink may take, and the least size of a mark.
CONTRAST, LEAST_INK, MOST_INK, LEAST_SIDE = 24.0, 0.012, 0.5, 5
#: Paper darker than this is read again; a slash leans at least so clearly, a U is at least so open between its stems.
DARK_PAPER, LEAN, OPEN = 130.0, 0.72, 0.15


def components(mask: np.ndarray) -> list[np.ndarray]:
    """The 8-connected components of a mask as arrays of (y, x), the largest first (then the first)."""
    parent: list[int] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    runs: list[tuple[int, int, int]] = []
    before: list[int] = []
    for y, row in enumerate(mask):
        edge = np.diff(np.r_[0, row.astype(np.int8), 0])
        now = []
        for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
            k = len(runs)
            runs.append((y, int(a), int(b)))
            parent.append(k)
            now.append(k)
            for j in before:
                if runs[j][1] <= b and runs[j][2] >= a:
                    parent[root(k)] = root(j)
        before = now
    pixels: dict[int, list[np.ndarray]] = {}
    for k, (y, a, b) in enumerate(runs):
        x = np.arange(a, b)
        pixels.setdefault(root(k), []).append(np.c_[np.full(len(x), y), x])
    return sorted((np.concatenate(p) for p in pixels.values()), key=lambda p: -len(p))


@dataclass
class Shape:
    """What tells a mark: size, holes, how often scan lines at parts of its height
    cross it, its slope, and the narrowest gap between two strokes (share of the width)."""

    width: int
    height: int
    holes: int
    crossings: tuple[int, ...]
    slope: float
    gap: float


def _runs(row: np.ndarray) -> int:
    return int((np.diff(np.r_[0, row.astype(np.int8)]) == 1).sum())


def shape(pixels: np.ndarray) -> Shape:
    y, x = (pixels - pixels.min(axis=0)).T
    own = np.zeros((y.max() + 1, x.max() + 1), bool)
    own[y, x] = True
    h, w = own.shape
    crossings = tuple(_runs(own[min(h - 1, int(h * at))]) for at in (0.1, 0.3, 0.5, 0.7, 0.92))
    slope = float(np.corrcoef(x, y)[0, 1]) if x.std() > 0 and y.std() > 0 else 0.0
    gaps = [np.diff(np.flatnonzero(own[min(h - 1, int(h * at))])) for at in (0.1, 0.3, 0.5, 0.7)]
    gap = min(float(g.max() - 1) if len(g) else 0.0 for g in gaps) / w
    return Shape(w, h, holes(own), crossings, slope, gap)


def holes(component: np.ndarray) -> int:
    """Enclosed areas of paper in one 8-connected component: one less its Euler
    number, which counts of 2 x 2 squares with one, three and two opposite pixels give."""
    p = np.pad(component, 1).astype(np.int8)
    a, b, c, d = p[:-1, :-1], p[:-1, 1:], p[1:, :-1], p[1:, 1:]
    filled = a + b + c + d
    opposite = (filled == 2) & (a == d)
    return int(1 - ((filled == 1).sum() - (filled == 3).sum() - 2 * opposite.sum()) // 4)


def ink(cell: np.ndarray, light: bool | None = None) -> np.ndarray:
    """The mask of ink: what differs from the paper (the median) by a third of
    the cell's range, darker or (``light``) lighter; by default the side with more contrast."""
    g = cell.astype(np.float64)
    paper = float(np.median(g))
    low, high = paper - float(np.percentile(g, 2)), float(np.percentile(g, 98)) - paper
    if light is None:
        light = high > low
    span = high if light else low
    if span < CONTRAST:
        return np.zeros(cell.shape, bool)
    return (g >= paper + span * 0.4) if light else (g <= paper - span * 0.4)


def mark(cell: np.ndarray, light: bool | None = None) -> str | None:
    """'U', '/' or null: the short mark of one cell."""
    if min(cell.shape) < 6:
        return None
    mask = ink(cell, light)
    if not LEAST_INK <= mask.mean() <= MOST_INK:
        return None
    s = shape(components(mask)[0])
    if s.holes or max(s.width, s.height) < LEAST_SIDE:
        return None
    if s.slope <= -LEAN and max(s.crossings) == 1 and s.height >= 0.5 * s.width:
        return "/"
    if s.gap >= OPEN and set(s.crossings[:4]) == {2} and s.crossings[4] == 1:
        return "U"
    return None


def wider(mask: np.ndarray, radius: int = 1) -> np.ndarray:
    """Strokes widened by ``radius``: running maxima along rows, then along columns."""
    out = mask.copy()
    for axis in (0, 1):
        grown = out.copy()
        for k in range(1, radius + 1):
            ahead, behind = np.roll(out, k, axis), np.roll(out, -k, axis)
            edge = [slice(None), slice(None)]
            edge[axis] = slice(0, k)
            ahead[tuple(edge)] = False
            edge[axis] = slice(out.shape[axis] - k, None)
            behind[tuple(edge)] = False
            grown |= ahead | behind
        out = grown
    return out


def second_mark(cell: np.ndarray) -> str | None:
    """The mark of a dark cell: light strokes, made dark by contrast to their surroundings, widened."""
    if min(cell.shape) < 6 or float(np.median(cell)) >= DARK_PAPER:
        return None
    contrast = local_contrast(cell, radius=max(4, min(cell.shape) // 2))
    strokes = wider(ink(contrast, light=False))
    return mark(np.where(strokes, 0, 255).astype(np.uint8), light=False)


def _each(cells: DataFrame, read: Callable[[np.ndarray], tuple[str | None, int | None]]) -> DataFrame:
    ship(cells.sparkSession)

    @F.pandas_udf("struct<glyph:string,pass:int>")
    def run(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        known = once(read)
        for width, height, pixels in parts:
            out = [(None, None) if p is None or w * h != len(p) or not len(p) else known(w, h, p) for w, h, p in zip(width, height, pixels, strict=True)]
            yield pd.DataFrame(out, columns=["glyph", "pass"]).astype({"glyph": object, "pass": "Int32"})

    return cells.select(*CELL, run(F.coalesce("width", F.lit(0)), F.coalesce("height", F.lit(0)), "pixels").alias("r")).select(*CELL, "r.glyph", "r.pass")


def marks(cells: DataFrame) -> DataFrame:
    """(page_id, row_idx, day_idx, glyph) of grey cell rasters (page_id, row_idx,
    day_idx, width, height, pixels); a raster that is null or not of its size has none."""
    return _each(cells, lambda cell: (mark(cell), None)).drop("pass")


def first_reading(cells: DataFrame) -> DataFrame:
    """As marks(), but dark ink only, as a reader without inversion sees it."""
    return _each(cells, lambda cell: (mark(cell, light=False), None)).drop("pass")


def both_readings(cells: DataFrame) -> DataFrame:
    """(page_id, row_idx, day_idx, glyph, pass): the first reading, and where it is
    empty the second one of cells with dark paper. Only such cells are read again."""

    def read(cell: np.ndarray) -> tuple[str | None, int | None]:
        if first := mark(cell, light=False):
            return first, 1
        second = second_mark(cell)
        return second, 2 if second else None

    return _each(cells, read)


def tiles(pages: DataFrame, frames: DataFrame) -> DataFrame:
    """Cell rasters of pages (page_id, width, height, pixels), cut by frames
    (page_id, row_idx, day_idx, x0, y0, x1, y1). A page's frames travel with it,
    so each page is cut where it is; frames outside the page give no tile."""
    ship(pages.sparkSession)
    frame = F.struct("row_idx", "day_idx", *[F.col(c).cast("int").alias(c) for c in ("x0", "y0", "x1", "y1")])
    wanted = frames.groupBy("page_id").agg(F.collect_list(frame).alias("frames"))

    @F.pandas_udf("array<struct<row_idx:int,day_idx:int,width:int,height:int,pixels:binary>>")
    def cut(width: pd.Series, height: pd.Series, pixels: pd.Series, frames_: pd.Series) -> pd.Series:
        out = []
        for w, h, p, own in zip(width, height, pixels, frames_, strict=True):
            gray, rows = np.frombuffer(p, np.uint8).reshape(h, w), []
            for f in own:
                tile = gray[max(0, f["y0"]) : max(0, f["y1"]), max(0, f["x0"]) : max(0, f["x1"])]
                if tile.size:
                    rows.append({"row_idx": f["row_idx"], "day_idx": f["day_idx"], "width": tile.shape[1], "height": tile.shape[0], "pixels": tile.tobytes()})
            out.append(rows)
        return pd.Series(out)

    joined = pages.join(wanted, "page_id")
    return joined.select("page_id", F.explode(cut("width", "height", "pixels", "frames")).alias("t")).select("page_id", "t.*")
