"""People of a roster from name halves that stand on lines of their own.

A reader breaks 'Last, First' into halves, glues the first name of one person to
the last name of the next, and loses the order. Lines are cut into halves first;
then, page by page, last names and given names are paired by a matching of least
total cost (how far below and how far to the side the given name stands). A page
has a few dozen halves, so each page is one array in an Arrow batch."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..session import ship

PAGE = "page_id"
#: Cost of a half without a partner, in line heights; of a given name that stands before its last name; of a line height to the side.
ALONE, BEFORE, ASIDE = 2.0, 1.0, 0.25
HALF = r"^[A-ZÄÖÜ][A-Za-zÄÖÜäöüß\-']{1,24},?$"
TITLE = r"^(?:Dr|Prof|OÄ|OA|FA|CA|AA)\.?$"


def assigned(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of the matching of least total cost of all rows, at
    most as many as columns (shortest augmenting paths with potentials)."""
    n, m = cost.shape
    row_of, u, v = np.full(m + 1, -1), np.zeros(n), np.zeros(m + 1)
    for i in range(n):
        row_of[m], j = i, m
        least, before, done = np.full(m + 1, np.inf), np.full(m + 1, m), np.zeros(m + 1, bool)
        while row_of[j] >= 0:
            done[j] = True
            free = np.flatnonzero(~done[:m])
            over = cost[row_of[j], free] - u[row_of[j]] - v[free]
            better = over < least[free]
            least[free[better]], before[free[better]] = over[better], j
            k = free[int(np.argmin(least[free]))]
            step = least[k]
            seen = np.flatnonzero(done)
            u[row_of[seen]] += step
            v[seen] -= step
            least[free] -= step
            j = int(k)
        while j != m:
            row_of[j] = row_of[before[j]]
            j = int(before[j])
    return [(int(row_of[j]), j) for j in range(m) if row_of[j] >= 0]


def pair_cost(last: tuple[float, float], given: tuple[float, float], height: float) -> float:
    """What it costs that the given name at (x, y) belongs to the last name at (x, y)."""
    down, aside = (given[1] - last[1]) / height, abs(given[0] - last[0]) / height
    before = down <= -0.5 or (down < 0.5 and given[0] < last[0])
    return abs(down) + BEFORE * before + ASIDE * aside


def paired(lasts: Sequence[tuple[float, float]], givens: Sequence[tuple[float, float]], height: float) -> list[tuple[int, int]]:
    """Pairs of least total cost; a half stays alone where a partner costs more than two halves alone."""
    if not lasts or not givens:
        return []
    n, m = len(lasts), len(givens)
    cost = np.full((n + m, n + m), np.inf)  # every half may also stay alone
    cost[:n, :m] = [[pair_cost(a, b, height) for b in givens] for a in lasts]
    np.fill_diagonal(cost[:n, m:], ALONE)
    np.fill_diagonal(cost[n:, :m], ALONE)
    cost[n:, m:] = 0.0
    return [(i, j) for i, j in assigned(np.where(np.isfinite(cost), cost, 1e9)) if i < n and j < m]


def halves(tokens: DataFrame, given: DataFrame) -> DataFrame:
    """Tokens (page_id, x, y, w, h, text) of the name column, cut into single
    words: page_id, x, y, h, word, role ('last', 'given' or 'whole').

    'Meier, Eva' is whole; a word with a comma behind it is a last name, one of
    the names in ``given`` (name) a given name; other words are last names.
    Titles and what no name looks like are left out. A glued line ('Eva Schulz,')
    falls into its halves, each with its share of the width."""
    clean = F.trim(F.regexp_replace("text", r"\s+", " "))
    whole = text.plausible_person(clean) & clean.contains(", ")
    parts = F.when(whole, F.array(clean)).otherwise(F.filter(F.split(clean, " "), lambda t: ~t.rlike(TITLE)))
    words = tokens.withColumn("_n", F.length(clean)).select(PAGE, "x", "y", "w", "h", "_n", clean.alias("_t"), F.posexplode(parts).alias("k", "word")).where(F.col("word").rlike(HALF) | F.col("word").contains(", "))
    at = F.col("x") + F.col("w") * (F.position(F.col("word"), F.col("_t")) - 1) / F.greatest(F.col("_n"), F.lit(1))
    known = given.select(text.name_key(F.col("name")).alias("_key"), F.lit(True).alias("_given")).distinct()
    rows = words.select(PAGE, at.alias("x"), "y", "h", "word", text.name_key(F.col("word")).alias("_key")).join(known, "_key", "left")
    role = F.when(F.col("word").contains(", "), "whole").when(F.col("word").endswith(","), "last").when(F.col("_given"), "given").otherwise("last")
    return rows.select(PAGE, "x", "y", "h", "word", role.alias("role"))


def people(tokens: DataFrame, given: DataFrame) -> DataFrame:
    """(page_id, row_idx, person, y): the people of each page from top to bottom,
    'Last, First', paired from halves(); a last name alone stays alone, a given
    name alone is dropped. Pages without names give no rows."""
    ship(tokens.sparkSession)
    found = halves(tokens, given)

    @F.pandas_udf("array<struct<person:string,y:double>>")
    def run(arrays: pd.Series) -> pd.Series:
        out = []
        for page in arrays:
            height = float(np.median([w["h"] for w in page])) or 1.0
            of = {role: [w for w in page if w["role"] == role] for role in ("whole", "last", "given")}
            pairs = dict(paired([(w["x"], w["y"]) for w in of["last"]], [(w["x"], w["y"]) for w in of["given"]], height))
            rows = [{"person": w["word"], "y": float(w["y"])} for w in of["whole"]]
            for i, w in enumerate(of["last"]):
                last = w["word"].rstrip(",")
                rows.append({"person": f"{last}, {of['given'][pairs[i]]['word'].rstrip(',')}" if i in pairs else last, "y": float(w["y"])})
            out.append(rows)
        return pd.Series(out)

    word = F.struct("y", "x", "word", "role", "h")
    pages = found.groupBy(PAGE).agg(F.array_sort(F.collect_list(word)).alias("words"))
    rows = pages.select(PAGE, F.explode(run("words")).alias("p")).select(PAGE, "p.person", "p.y")
    return rows.withColumn("row_idx", (F.row_number().over(Window.partitionBy(PAGE).orderBy("y", "person")) - 1).cast("int")).select(PAGE, "row_idx", "person", "y")


def given_of(names: Column) -> Column:
    """The first given name of a stored 'Last, First': the vocabulary for halves()."""
    return F.element_at(F.split(text.roster_name(names)["first"], " "), 1)
