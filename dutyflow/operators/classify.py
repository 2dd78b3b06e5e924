"""Document kinds, layout scores and choices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lookups import small
from .sequences import best_and_second, keep_first

LEAST_SCORE = 0.42


def valid_patterns(spark, patterns: Sequence[str]) -> list[str]:
    """Patterns that compile; a bad one in a rule table is left out, not fatal."""
    good = []
    for p in patterns:
        try:
            spark._jvm.java.util.regex.Pattern.compile(p)
            good.append(p)
        except Exception:  # noqa: BLE001 - the gateway wraps PatternSyntaxException
            continue
    return good


def any_match(x: Column, patterns: Sequence[str]) -> Column:
    return F.coalesce(*[F.when(x.rlike(p), F.lit(True)) for p in patterns], F.lit(False)) if patterns else F.lit(False)


def all_match(x: Column, patterns: Sequence[str]) -> Column:
    out = F.lit(True)
    for p in patterns:
        out = out & F.coalesce(x.rlike(p), F.lit(False))
    return out


def first_kind(x: Column, rules: Sequence[tuple[str, Sequence[str]]], otherwise: str = "unknown") -> Column:
    """The first kind all of whose patterns match."""
    out = F.lit(otherwise)
    for kind, patterns in reversed(rules):
        out = F.when(all_match(x, patterns), F.lit(kind)).otherwise(out)
    return out


# fixed values: markers of payslips and shift plans
PAYSLIP = (r"(?iu)Verdienstabrechnung", r"(?iu)Abrechnungsmonat", r"\b(LA|BRG)\b")
PLAN = (
    (r"(?iu)Zeitprotokoll|Zeitdaten|Dienstplan|Schichtplan|Buchungen",),
    (r"(?iu)Soll/Ist|Anwesend|Schichtfrei", r"\b(MO|DI|MI|DO|FR|SA|SO)\b"),
    (r"(?iu)Kalendarium|Monatsübersicht", r"\d{1,2}\.\d{1,2}\.\d{2,4}"),
    (r"(?iu)Zeitabrechnung", r"(?iu)KO\s*\*", r"(?iu)GE\s*\*"),
)


def is_payslip(x: Column) -> Column:
    return all_match(x, PAYSLIP)


def is_plan(x: Column) -> Column:
    out = F.lit(False)
    for patterns in PLAN:
        out = out | all_match(x, patterns)
    return out & ~is_payslip(x)


def document_kind(x: Column, payslip: Sequence[str] = (), shift: Sequence[str] = (), grid: Column | None = None) -> Column:
    """'payslip', 'shift' or 'unknown': a pack's own patterns first, then a code grid, then general marks; payslip wins ties."""
    grid = F.lit(False) if grid is None else grid
    return F.when(any_match(x, payslip), "payslip").when(any_match(x, shift), "shift").when(grid, "shift").when(is_payslip(x), "payslip").when(is_plan(x), "shift").otherwise("unknown")


def code_hits(docs: DataFrame, key: str, text: str, codes: DataFrame, least: int = 10) -> DataFrame:
    """(key, hits, enough): duty code tokens of each text, by a semi-join with the
    spellings. A token ends where ASCII letters, digits and underscores do."""
    token = r"(?<![A-Za-z0-9_])[A-Za-z][A-Za-z0-9]{0,5}(?![A-Za-z0-9_])|//|/"
    tokens = F.explode(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(token), F.lit(0)))
    rows = docs.select(key, tokens.alias("t")).select(key, F.upper("t").alias("spelling"))
    own = F.col("spelling").isin("/", "//")
    known = rows.join(small(codes.select("spelling", F.lit(True).alias("_in"))), "spelling", "left")
    counted = known.groupBy(key).agg(F.count_if(F.coalesce("_in", own)).alias("hits"))
    return docs.select(key).join(counted, key, "left").select(key, F.coalesce("hits", F.lit(0)).alias("hits")).withColumn("enough", F.col("hits") >= least)


def looks_like_grid(x: Column, require: Sequence[str], reject: Sequence[str], enough: Column) -> Column:
    return all_match(x, require) & ~any_match(x, reject) & x.rlike("[A-Za-zÄÖÜäöüß]{2,},\\s*[A-Za-zÄÖÜäöüß]") & enough


def line_score(x: Column, weights: Sequence[tuple[str, int]]) -> Column:
    """Sum of weights of the patterns that match, over the lines."""
    score = lambda line: sum((F.when(line.rlike(p), F.lit(w)).otherwise(F.lit(0)) for p, w in weights), F.lit(0))
    return F.aggregate(F.transform(F.split(x, "\n"), score), F.lit(0).cast("long"), lambda a, s: a + s)


# fixed values: lines and words of lists and time sheets, and their weights
LIST_LINES = ((r"^\s*\d{4}-\d{2}-\d{2}\s+[^\s,;]+", 2), (r"^\s*\d{2}\.\d{2}\.\d{4}\s+[^\s,;]+", 2))
SHEET_LINES = ((r"^\s*\d{1,2}\b.*\d{1,2}:\d{2}\s*[-–]\s*\d{1,2}:\d{2}", 2), (r"(?i)^\s*(URLAUB|URLTV|KRANK|KR|KROAU|FEIER|FEIERTAG|FREI)\b", 1))
SHEET_MARKS = ((r"(?iu)Abrechnungsmonat", 5), (r"(?iu)(?:Ü|Ue|U)bertrag", 2), (r"(?iu)Periode\s*\(", 2), (r"(?iu)Bereitschaft", 1))


def list_score(x: Column) -> Column:
    head = F.lower(F.array_join(F.slice(F.split(x, "\n"), 1, 3), " "))
    named = F.when(head.rlike(r"\bdate\b") & head.rlike(r"\btype\b"), 4).otherwise(0) + F.when(head.rlike(r"\bdatum\b") & head.rlike(r"\b(dienst|code|typ)\b"), 4).otherwise(0)
    return line_score(x, LIST_LINES) + named


def sheet_score(x: Column) -> Column:
    return line_score(x, SHEET_LINES) + sum((F.when(x.rlike(p), w).otherwise(0) for p, w in SHEET_MARKS), F.lit(0))


def choose_layout(scores: DataFrame, key: str, priors: dict[str, float] | None = None, least: float = LEAST_SCORE) -> DataFrame:
    """(key, layout, score): the best layout after priors, the first of equal ones; below ``least`` 'text'.

    scores: key, layout, ord, score."""
    bonus = F.lit(0.0)
    for name, value in (priors or {}).items():
        bonus = F.when(F.col("layout") == name, F.lit(value)).otherwise(bonus)
    rows = scores.withColumn("score", F.least(F.greatest(F.col("score") + bonus, F.lit(0.0)), F.lit(1.0)))
    best = keep_first(rows, [key], [F.desc("score"), "ord"])
    return best.select(key, F.when(F.col("score") >= least, F.col("layout")).otherwise("text").alias("layout"), "score")


def uncertain(scores: DataFrame, key: str, gap: float = 0.12) -> DataFrame:
    """Keys whose best two layouts are closer than ``gap``, with best and second."""
    return best_and_second(scores, [key], "score", "ord").withColumn("ask", F.col("gap") < gap)


def merge_scores(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The larger score of two passes for each layout."""
    both = a.join(b.withColumnRenamed("score", "_score"), list(keys), "full_outer")
    return both.withColumn("score", F.greatest("score", "_score")).drop("_score")


def axis_cues(tokens: DataFrame, page: str) -> DataFrame:
    """Counts of dates at the left, weekday headers and bare day numbers of each page."""
    t = F.trim("text")
    wide = tokens.join(tokens.groupBy(page).agg(F.max(F.col("x") + F.col("w")).alias("_width")), page)
    return wide.groupBy(page).agg(
        F.count_if(t.rlike(r"^\d{1,2}\.\d{1,2}\.(\d{2,4})?$") & (F.col("x") < F.col("_width") * 0.3)).alias("left_dates"),
        F.count_if(t.rlike(r"(?i)^(Mo|Di|Mi|Do|Fr|Sa|So)\.?\s*\d{0,2}$")).alias("weekdays"),
        F.count_if(t.rlike(r"^([1-9]|[12]\d|3[01])$")).alias("day_numbers"),
    )


def region_report(found: DataFrame, truth: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Overlap of each true box with the box found for it; a missing one counts 0."""
    from ..functions.numbers import box_overlap

    boxes = [F.col(c) for c in ("x", "y", "w", "h")]
    other = found.select(*keys, *[F.col(c).alias(f"_{c}") for c in ("x", "y", "w", "h")])
    rows = truth.join(other, list(keys), "left")
    return rows.select(*keys, F.coalesce(box_overlap(*boxes, *[F.col(f"_{c}") for c in ("x", "y", "w", "h")]), F.lit(0.0)).alias("overlap"), F.coalesce(F.abs(F.col("x") - F.col("_x")), F.lit(None)).alias("error"))
