"""Cells of a roster grid that a reader garbled: from digit soup to duty codes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

# fixed values: letters read for digits, and digits that are mistaken for each other
FOLD = str.maketrans("OQDILZSGB", "000112568")
CONFUSED = {"0": "68", "1": "7", "2": "7", "3": "8", "5": "6", "6": "05", "7": "12", "8": "03"}


def digits(cell: str) -> str:
    return "".join(c for c in cell.upper().translate(FOLD) if c.isdigit())


def variants(soup: str, swaps: int = 2) -> list[str]:
    """The soup with up to ``swaps`` confused digits replaced, nearest first."""
    out = {soup: 0}
    for depth in range(1, swaps + 1):
        for text in [t for t, d in out.items() if d == depth - 1]:
            for i, c in enumerate(text):
                for other in CONFUSED.get(c, ""):
                    out.setdefault(text[:i] + other + text[i + 1 :], depth)
    return list(out)


def resolve(cell: str, rules: Sequence[tuple[str, str, str]]) -> tuple[str | None, str]:
    """(code, how): an exact pair of clocks; a start or end that only one rule
    has; a pair anywhere in the soup; one digit off; a confused digit."""
    soup = digits(cell or "")
    prints = [(s.replace(":", "") + e.replace(":", ""), c) for s, e, c in rules]
    exact = [c for p, c in prints if p == soup]
    if exact:
        return exact[0], "exact"
    if len(soup) == 4:
        for how, side in (("start", slice(0, 4)), ("end", slice(4, 8))):
            hits = {c for p, c in prints if p[side] == soup}
            if len(hits) == 1:
                return hits.pop(), how
        return None, "none"
    if len(soup) >= 8:
        windows = [soup[i : i + 8] for i in range(len(soup) - 7)]
        for w in windows:
            if hit := [c for p, c in prints if p == w]:
                return hit[0], "window"
        near = {c for w, (p, c) in product(windows, prints) if sum(a != b for a, b in zip(w, p, strict=True)) == 1}
        if len(near) == 1:
            return near.pop(), "one-off"
        for v in variants(soup[:8])[1:]:
            if hit := [c for p, c in prints if p == v]:
                return hit[0], "confused"
    return None, "none"


def resolve_cells(df: DataFrame, cell: str, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Adds code and how; each distinct cell is resolved once and joined back."""

    ship(df.sparkSession)

    @F.pandas_udf("struct<code:string,how:string>")
    def one(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([resolve(x, rules) for x in part], columns=["code", "how"])

    known = df.select(cell).distinct().withColumn("r", one(cell)).select(cell, "r.code", "r.how")
    return df.join(known, cell, "left")
