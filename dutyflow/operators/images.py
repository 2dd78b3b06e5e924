"""Raster and geometry kernels in numpy, applied to binary columns by Arrow UDFs."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship

LONG_EDGE = (1800, 3000)
#: So many rasters a task remembers with what was read in them.
REMEMBERED = 4096


def once(read: Callable) -> Callable:
    """``read`` of a grey raster as a function of (width, height, bytes) that
    reads equal rasters (empty cells, forms) once while they are remembered."""
    return lru_cache(REMEMBERED)(lambda w, h, p: read(np.frombuffer(p, np.uint8).reshape(h, w)))


def profile(gray: np.ndarray, axis: int) -> np.ndarray:
    """Mean edge strength along each row (axis 0: differences between rows) or column."""
    if min(gray.shape) < 2:
        return np.zeros(gray.shape[axis])
    d = np.abs(np.diff(gray.astype(np.int32), axis=axis)).mean(axis=1 - axis)
    return np.r_[d, 0.0]


def peaks(values: np.ndarray, share: float = 0.5, apart: int = 3) -> list[int]:
    """Places of local maxima above ``share`` of the largest, at least ``apart`` from a stronger one."""
    if not len(values) or values.max() <= 0:
        return []
    out: list[int] = []
    for i in np.argsort(-values, kind="stable"):
        if values[i] < share * values.max():
            break
        if all(abs(int(i) - j) >= apart for j in out):
            out.append(int(i))
    return sorted(out)


def grid_metrics(gray: np.ndarray) -> dict[str, float]:
    """Numbers of ruled rows and columns, and how even their steps are (1: fully)."""
    out = {}
    for name, axis in (("rows", 0), ("columns", 1)):
        at = peaks(profile(gray, axis))
        steps = np.diff(at)
        out[name] = float(len(at))
        out[f"{name}_even"] = float(1 - min(1.0, steps.std() / steps.mean())) if len(steps) > 1 else 0.0
    return out


def skew_degrees(gray: np.ndarray, most: float = 5.0, step: float = 0.25) -> float:
    """The angle whose shear makes row sums most uneven (text and rules level)."""
    # columns of one shift are summed before they are shifted; sums of whole numbers are exact in any order
    left = np.pad((255 - gray.astype(np.float64)).cumsum(axis=1), ((0, 0), (1, 0)))
    x = np.arange(gray.shape[1]) - gray.shape[1] / 2
    best, angle = -1.0, 0.0
    for a in np.arange(-most, most + step / 2, step):
        shift = np.rint(np.tan(math.radians(a)) * x).astype(int)
        edge = np.r_[0, np.flatnonzero(np.diff(shift)) + 1, len(shift)]
        rows = (np.arange(gray.shape[0])[:, None] + shift[None, edge[:-1]]) % gray.shape[0]
        score = float(np.var(np.take_along_axis(left[:, edge[1:]] - left[:, edge[:-1]], rows, axis=0).sum(axis=1)))
        if score > best * (1 + 1e-9) or (abs(score - best) <= 1e-9 * max(best, 1) and abs(a) < abs(angle)):
            best, angle = score, float(a)
    return angle


def upright(gray: np.ndarray, wide: bool) -> np.ndarray:
    """Turned by 90 degrees clockwise if the page does not lie as expected."""
    return np.rot90(gray, -1) if (gray.shape[1] >= gray.shape[0]) != wide else gray


def homography(source: Sequence[Sequence[float]], target: Sequence[Sequence[float]]) -> np.ndarray | None:
    """The 3x3 map of four points to four points; None if they are degenerate."""
    rows, right = [], []
    for (x, y), (u, v) in zip(source, target, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    m = np.array(rows, float)
    if abs(np.linalg.det(m)) < 1e-9:
        return None
    return np.r_[np.linalg.solve(m, np.array(right, float)), 1.0].reshape(3, 3)


def apply_points(h: np.ndarray, points: np.ndarray) -> np.ndarray:
    p = np.c_[np.asarray(points, float), np.ones(len(points))] @ h.T
    return p[:, :2] / p[:, 2:]


def round_trip(h: np.ndarray, points: np.ndarray) -> float:
    """Root mean square distance of points after the map and its inverse."""
    back = apply_points(np.linalg.inv(h), apply_points(h, points))
    return float(np.sqrt(((back - np.asarray(points, float)) ** 2).sum(axis=1).mean()))


def convex(quad: Sequence[Sequence[float]]) -> bool:
    p = np.asarray(quad, float)
    e = np.roll(p, -1, axis=0) - p
    after = np.roll(e, -1, axis=0)
    turn = e[:, 0] * after[:, 1] - e[:, 1] * after[:, 0]
    return bool((turn > 0).all() or (turn < 0).all())


def map_columns(h: Column, x: Column, y: Column) -> Column:
    """(x, y) under a map held as array<double> of nine, as column arithmetic."""
    part = lambda i: F.element_at(h, i + 1) * x + F.element_at(h, i + 2) * y + F.element_at(h, i + 3)
    return F.struct((part(0) / part(6)).alias("x"), (part(3) / part(6)).alias("y"))


def local_contrast(gray: np.ndarray, radius: int = 8) -> np.ndarray:
    """Light glyphs made dark: how much brighter a pixel is than its surroundings (by an integral image), inverted."""
    g = gray.astype(np.float64)
    total = np.pad(g.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    y0, y1 = np.clip(np.arange(g.shape[0]) - radius, 0, None), np.clip(np.arange(g.shape[0]) + radius + 1, None, g.shape[0])
    x0, x1 = np.clip(np.arange(g.shape[1]) - radius, 0, None), np.clip(np.arange(g.shape[1]) + radius + 1, None, g.shape[1])
    area = (y1 - y0)[:, None] * (x1 - x0)[None, :]
    mean = (total[y1][:, x1] - total[y0][:, x1] - total[y1][:, x0] + total[y0][:, x0]) / area
    return np.clip(255 - 4 * np.maximum(g - mean, 0), 0, 255).astype(np.uint8)


def ink_share(cell: np.ndarray, dark: int = 110) -> float:
    return float((cell < dark).mean()) if cell.size else 0.0


def slash_share(cell: np.ndarray, dark: int = 110) -> float:
    """Share of the rising diagonal band that is dark."""
    if min(cell.shape) < 4:
        return 0.0
    h, w = cell.shape
    y, x = np.mgrid[0:h, 0:w]
    band = np.abs(y / (h - 1) + x / (w - 1) - 1) < 0.12
    return float((cell[band] < dark).mean())


def resize_target(width: int, height: int) -> tuple[int, int]:
    """Size whose long edge lies in LONG_EDGE, same proportions."""
    longest = max(width, height)
    if longest <= 0:
        return width, height
    scale = min(max(longest, LONG_EDGE[0]), LONG_EDGE[1]) / longest
    return max(1, round(width * scale)), max(1, round(height * scale))


def jpeg_size(data: bytes) -> tuple[int, int] | None:
    """(width, height) from the frame header."""
    i = 2
    while i + 9 < len(data):
        if data[i] != 0xFF:
            i += 1
            continue
        kind = data[i + 1]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(data[i + 7 : i + 9], "big"), int.from_bytes(data[i + 5 : i + 7], "big")
        i += 2 + int.from_bytes(data[i + 2 : i + 4], "big") if kind not in (0xFF, 0xD8, 0x01) else 1
    return None


def page_metrics(pages: DataFrame) -> DataFrame:
    """(page_id, rows, columns, rows_even, columns_even, skew) of grey rasters (page_id, width, height, pixels binary)."""
    ship(pages.sparkSession)

    @F.pandas_udf("struct<rows:double,columns:double,rows_even:double,columns_even:double,skew:double>")
    def measure(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        read = once(lambda gray: grid_metrics(gray) | {"skew": skew_degrees(gray)})
        for width, height, pixels in parts:
            out = [read(w, h, p) for w, h, p in zip(width, height, pixels, strict=True)]
            yield pd.DataFrame(out, columns=["rows", "columns", "rows_even", "columns_even", "skew"])

    return pages.select("page_id", measure("width", "height", "pixels").alias("m")).select("page_id", "m.*")


def layout_of(metrics: DataFrame, *more: str) -> DataFrame:
    """(page_id, layout, and columns of ``more``): many even columns are a month, about seven a week, many rows with few columns a list."""
    c, r = F.col("columns"), F.col("rows")
    return metrics.select("page_id", F.when((c >= 20) & (r >= 3), "month").when(c.between(6, 10) & (r >= 3), "week").when((r >= 8) & (c < 6), "list").otherwise("unknown").alias("layout"), *more)


def warp(gray: np.ndarray, back: np.ndarray, size: tuple[int, int], paper: int = 255) -> np.ndarray:
    """The raster of (height, width) whose pixel (x, y) shows the point that
    ``back`` maps it to, mixed from its four neighbours; ``paper`` outside."""
    height, width = size
    y, x = np.mgrid[0:height, 0:width]
    at = apply_points(back, np.c_[x.ravel(), y.ravel()])
    u, v = at[:, 0], at[:, 1]
    inside = (u >= 0) & (v >= 0) & (u <= gray.shape[1] - 1) & (v <= gray.shape[0] - 1)
    u, v = np.clip(u, 0, gray.shape[1] - 1), np.clip(v, 0, gray.shape[0] - 1)
    x0, y0 = np.minimum(u.astype(int), gray.shape[1] - 2), np.minimum(v.astype(int), gray.shape[0] - 2)
    dx, dy = u - x0, v - y0
    g = gray.astype(np.float64)
    top = g[y0, x0] * (1 - dx) + g[y0, x0 + 1] * dx
    low = g[y0 + 1, x0] * (1 - dx) + g[y0 + 1, x0 + 1] * dx
    out = np.where(inside, top * (1 - dy) + low * dy, paper)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8).reshape(height, width)


def page_quad(gray: np.ndarray, bright: int = 128, least: float = 0.1) -> list[tuple[float, float]] | None:
    """The corners (from the upper left, clockwise) of a bright page on a dark
    ground: the outermost bright pixels towards each corner; None without a
    convex quadrangle that takes ``least`` of the picture."""
    y, x = np.nonzero(gray >= bright)
    if not len(x):
        return None
    corner = [int(np.argmin(x + y)), int(np.argmax(x - y)), int(np.argmax(x + y)), int(np.argmin(x - y))]
    quad = [(float(x[i]), float(y[i])) for i in corner]
    nxt = [*quad[1:], quad[0]]
    area = abs(sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(quad, nxt, strict=True))) / 2
    return quad if convex(quad) and area >= least * gray.size else None


def rectified(pages: DataFrame, width: int, height: int) -> DataFrame:
    """(page_id, pixels, forward) of photographed pages (page_id, width, height,
    pixels): each page seen straight on as a raster of width x height, and the
    map (array of nine) from the photo to it for map_columns(). Without a page in
    the picture both are null."""
    ship(pages.sparkSession)
    target = [(0.0, 0.0), (width - 1.0, 0.0), (width - 1.0, height - 1.0), (0.0, height - 1.0)]

    @F.pandas_udf("struct<pixels:binary,forward:array<double>>")
    def run(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for w, h, pixels in parts:
            out = []
            for a, b, p in zip(w, h, pixels, strict=True):
                gray = np.frombuffer(p, np.uint8).reshape(b, a)
                quad = page_quad(gray)
                forward = homography(quad, target) if quad else None
                out.append((None, None) if forward is None else (warp(gray, np.linalg.inv(forward), (height, width)).tobytes(), forward.ravel().tolist()))
            yield pd.DataFrame(out, columns=["pixels", "forward"])

    return pages.select("page_id", run("width", "height", "pixels").alias("r")).select("page_id", "r.pixels", "r.forward")
