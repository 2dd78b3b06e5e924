"""Rows of a photographed roster, rewritten pass by pass.

A reader leaves printed codes, clocks, torn clocks and ink behind. The passes
run in a fixed order and each sees what earlier ones left, so a row is worked on
as a whole: its cells (a few dozen days) are gathered into one array, an Arrow
batch of rows goes through the passes, and every cell comes back with the names
of the passes that changed it. Rows are independent of each other.

The pass that reads clocks (``stream``) is a segmentation of all digits of the
row by dynamic programming: a window of eight digits is a duty's start and end
at the cost of its wrong digits, it belongs to the cell in which it begins, and
it may borrow from the cell to the right."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .cells import digits

PAGE = "page_id"
#: Wrong digits that a window may have, what a digit outside all windows costs, and a start or end alone.
WRONG, LOST, HALF = 2, 1, 1
#: Ink: dark cells are vacation, a slash over a cell takes it back.
DARK, SLASH, CLEAR_SLASH, OVER_DARK = 0.70, 0.28, 0.40, 0.12
FREE = "/"


@dataclass
class Duties:
    """The code table of a roster: (start, end, code) of timed duties, other codes, and the vacation code."""

    timed: Sequence[tuple[str, str, str]]
    others: Sequence[str] = ()
    vacation: str = "U"

    def __post_init__(self) -> None:
        self.prints = [(s.replace(":", "") + e.replace(":", ""), c) for s, e, c in self.timed]
        self.known = {c.upper(): c for *_, c in self.timed} | {c.upper(): c for c in (*self.others, self.vacation)}
        self.nights = {c for s, e, c in self.timed if e < s}
        self.days = {c for *_, c in self.timed} - self.nights
        self.table = np.array([[int(d) for d in p] for p, _ in self.prints], np.int8).reshape(-1, 8)
        self.halves = {}
        for side in (slice(0, 4), slice(4, 8)):
            parts = [p[side] for p, _ in self.prints]
            self.halves |= {x: [c for p, c in self.prints if p[side] == x][0] for x in parts if len({c for p, c in self.prints if x in (p[:4], p[4:])}) == 1}


@dataclass
class Row:
    """One person's row: what stands in the cells now, what was read, and ink."""

    cells: list[str]
    texts: list[str]
    weekend: list[bool]
    dark: list[float]
    slash: list[float]
    left: list[str] = field(default_factory=list)

    def open(self, i: int) -> bool:
        return self.cells[i] in ("", FREE)


def segments(soup: Sequence[str], duties: Duties, closed: Sequence[bool] = (), weekend: Sequence[bool] = ()) -> tuple[int, list[tuple[int, int, str]]]:
    """(cost, [(first digit, length, code)]) of the cheapest reading of the digits
    of a row's cells. Windows do not overlap, begin in cells that are not closed
    (on weekends: no day duties), at most one in each, and end in the same or the
    next cell. Among readings of one cost the first in the order of (first digit,
    length, rule) wins."""
    stream = "".join(soup)
    owner = [i for i, s in enumerate(soup) for _ in s]
    n = len(stream)
    after = [0] * (len(soup) + 1)  # the first digit behind each cell
    for i, s in enumerate(soup):
        after[i + 1] = after[i] + len(s)
    options: list[list[tuple[int, int, int, str]]] = [[] for _ in range(n)]
    if n >= 8 and len(duties.table):
        values = np.lib.stride_tricks.sliding_window_view(np.frombuffer(stream.encode(), np.uint8) - 48, 8)
        wrong = (values[:, None, :] != duties.table[None, :, :]).sum(axis=2)
        for i, r in zip(*np.nonzero(wrong <= WRONG), strict=True):
            options[i].append((8, int(r), int(wrong[i, r]), duties.prints[r][1]))
    for i in range(n - 3):
        if (code := duties.halves.get(stream[i : i + 4])) and owner[i + 3] == owner[i]:
            options[i].append((4, -1, HALF, code))
    best: list[tuple[int, tuple]] = [(0, ())] * (n + 1)
    for i in range(n - 1, -1, -1):
        best[i] = (best[i + 1][0] + LOST, best[i + 1][1])
        cell = owner[i]
        if cell < len(closed) and closed[cell]:
            continue
        for length, rule, cost, code in options[i]:
            if owner[i + length - 1] <= cell + 1 and not (cell < len(weekend) and weekend[cell] and code in duties.days):
                go_on = max(i + length, after[cell + 1])
                tail = best[go_on]
                best[i] = min(best[i], (cost + (go_on - i - length) * LOST + tail[0], ((i, length, rule, code), *tail[1])))
    return best[0][0], [(i, length, code) for i, length, _, code in best[0][1]]


def printed(row: Row, duties: Duties) -> None:
    """Codes that stand in a cell as such."""
    for i, read in enumerate(row.texts):
        found = [duties.known[t.upper()] for t in read.split() if t.upper() in duties.known]
        if row.open(i) and found:
            row.cells[i] = found[0]


def stream(row: Row, duties: Duties) -> None:
    """Codes from clocks, also torn ones; cells with a code keep it but lend their digits."""
    soup = [digits(" ".join(t for t in read.split() if t.upper() not in duties.known)) for read in row.texts]
    _, found = segments(soup, duties, [not row.open(i) for i in range(len(row.cells))], row.weekend)
    owner = [i for i, s in enumerate(soup) for _ in s]
    used = {k for first, length, _ in found for k in range(first, first + length)}
    row.left = ["".join(d for k, d in enumerate("".join(soup)) if owner[k] == i and k not in used) for i in range(len(soup))]
    for first, _, code in found:
        row.cells[owner[first]] = code


def crumbs(row: Row, duties: Duties) -> None:
    """A cell in which only digits of an end are left goes on with the duty of the day before."""
    ends = {}
    for p, c in duties.prints:
        ends.setdefault(c, []).append(p[4:])
    left = row.left or ["" for _ in row.cells]
    for i in range(1, len(row.cells)):
        before = row.cells[i - 1]
        if row.open(i) and not (row.weekend[i] or row.weekend[i - 1]) and before in duties.days and 2 <= len(left[i]) <= 4 and any(left[i] in e for e in ends[before]):
            row.cells[i] = before


def ink(row: Row, duties: Duties) -> None:
    """Dark empty cells are vacation."""
    for i, dark in enumerate(row.dark):
        if row.cells[i] == "" and dark >= DARK:
            row.cells[i] = duties.vacation


def between(row: Row, duties: Duties) -> None:
    """Empty cells between two vacation days with nothing else in between."""
    last = None
    for i, cell in enumerate(row.cells):
        if cell == duties.vacation:
            if last is not None:
                row.cells[last + 1 : i] = [cell] * (i - last - 1)
            last = i
        elif cell:
            last = None


def long_gaps(row: Row, duties: Duties) -> None:
    """Empty runs of a week or more that begin on a weekend."""
    i = 0
    while i < len(row.cells):
        j = i
        while j < len(row.cells) and row.cells[j] == "":
            j += 1
        if j - i >= 7 and row.weekend[i]:
            row.cells[i:j] = [duties.vacation] * (j - i)
        i = max(j, i + 1)


def crossed(row: Row, duties: Duties) -> None:
    """Vacation and day duties that a slash crosses are free days, unless digits stand there that no other cell has used."""
    left = row.left or [digits(" ".join(t for t in read.split() if t.upper() not in duties.known)) for read in row.texts]
    for i, cell in enumerate(row.cells):
        slash, dark = row.slash[i], row.dark[i]
        if cell == duties.vacation and slash >= SLASH and slash > dark:
            row.cells[i] = FREE
        elif cell in duties.days and not left[i] and slash >= CLEAR_SLASH and slash > dark + OVER_DARK:
            row.cells[i] = FREE


def weekends(row: Row, duties: Duties) -> None:
    """Day duties do not stand on weekends."""
    for i, cell in enumerate(row.cells):
        if row.weekend[i] and cell in duties.days:
            row.cells[i] = ""


PASSES: tuple[Callable[[Row, Duties], None], ...] = (printed, stream, crumbs, ink, between, long_gaps, crossed, weekends, between)


def rewritten(row: Row, duties: Duties, passes: Sequence[Callable[[Row, Duties], None]] = PASSES) -> list[list[str]]:
    """Runs the passes over the row; for each cell the names of those that changed it, in order."""
    seen: list[list[str]] = [[] for _ in row.cells]
    for step in passes:
        before = list(row.cells)
        step(row, duties)
        for i, (a, b) in enumerate(zip(before, row.cells, strict=True)):
            if a != b:
                seen[i].append(step.__name__)
    return seen


def refine(grid: DataFrame, duties: Duties, passes: Sequence[Callable[[Row, Duties], None]] = PASSES) -> DataFrame:
    """The grid after all passes: page_id, row_idx, day_idx, cell and ``passes``
    (names of those that changed the cell, in order).

    grid: page_id, row_idx, day_idx, text (the cell's tokens, blanks between),
    weekend, dark and slash (0 to 1); nulls mean empty, no weekend, no ink. Cells
    without a row in the grid do not exist; a repeated cell is read once (its
    greatest text). A row of a page is one array, so tasks hold single rows."""
    ship(grid.sparkSession)
    cell = F.struct("day_idx", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("weekend", F.lit(False)).alias("weekend"), F.coalesce(F.col("dark").cast("double"), F.lit(0.0)).alias("dark"), F.coalesce(F.col("slash").cast("double"), F.lit(0.0)).alias("slash"))
    days = grid.groupBy(PAGE, "row_idx", "day_idx").agg(F.max(cell).alias("c"))
    rows = days.groupBy(PAGE, "row_idx").agg(F.array_sort(F.collect_list("c")).alias("cells"))

    @F.pandas_udf("array<struct<day_idx:int,cell:string,passes:array<string>>>")
    def run(arrays: pd.Series) -> pd.Series:
        out = []
        for cells in arrays:
            part = lambda k, cells=cells: [c[k] for c in cells]
            row = Row([""] * len(cells), part("text"), part("weekend"), part("dark"), part("slash"))
            seen = rewritten(row, duties, passes)
            out.append([{"day_idx": int(d), "cell": c, "passes": p} for d, c, p in zip(part("day_idx"), row.cells, seen, strict=True)])
        return pd.Series(out)

    return rows.select(PAGE, "row_idx", F.explode(run("cells")).alias("c")).select(PAGE, "row_idx", "c.*")


def read_streams(grid: DataFrame, duties: Duties) -> DataFrame:
    """The stream pass alone, after printed codes: page_id, row_idx, day_idx, cell, passes."""
    return refine(grid, duties, (printed, stream))
