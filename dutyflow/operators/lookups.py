"""Joins of shifts with rule tables: exact, nearest, reverse, chained, contained, fuzzy, ranges."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import numbers
from ..session import ship, spread
from . import nearest
from .sequences import keep_first

#: Rule tables of more rows are joined without a broadcast.
SMALL = 10_000
#: Left and right names of a block that one task compares, about.
LEFT_NAMES, RIGHT_NAMES = 4_000, 100_000


def small(df: DataFrame) -> DataFrame:
    """Broadcasts a rule table if a count shows that it has at most SMALL rows; else leaves the strategy to the planner."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def by_times(shifts: DataFrame, codes: DataFrame) -> DataFrame:
    """Left equi-join on (start, end); of several rules the first in table order."""
    first = keep_first(codes, ["start", "end"], ["ord"]).select("start", "end", F.col("code").alias("code"), F.col("validated").alias("validated"))
    return shifts.join(small(first), ["start", "end"], "left")


def nearest_end(rows: DataFrame, rules: DataFrame, row_id: str, key: str, value: str, rule_value: str, order: str = "ord") -> DataFrame:
    """Left nearest-match join: of the rules with an equal ``key`` first those
    whose ``rule_value`` covers ``value``, then the least distance, then rule order.

    Rules meet their rows in one equi-join (broadcast while they are few); the
    choice is an aggregate, so no row-sized sort is needed."""
    joined = rows.join(small(rules), key, "left")
    rank = F.struct((F.col(rule_value) < F.col(value)).cast("int").alias("short"), F.abs(F.col(rule_value) - F.col(value)).alias("far"), F.col(order).alias("ord"))
    own = [c for c in rules.columns if c != key]
    kept = [c for c in rows.columns if c != row_id]
    best = joined.groupBy(row_id).agg(*[F.first(c).alias(c) for c in kept], F.min_by(F.struct(*own), rank).alias("_rule"))
    return best.select(row_id, *kept, *[F.col("_rule")[c].alias(c) for c in own])


def resolve_times(shifts: DataFrame, codes: DataFrame, infer: bool = True) -> DataFrame:
    """Adds code, validated, inferred: the exact rule for (start, end), else the
    nearest planned end with the same start (as nearest_end). shifts: with start, end.

    The rules of a start are one array, so few rules cost the shifts no shuffle."""
    timed = codes.where(~F.col("is_special"))
    exact = keep_first(timed, ["start", "end"], ["ord"]).select("start", "end", F.col("code").alias("exact_code"), "validated")
    out = shifts.join(small(exact), ["start", "end"], "left")
    if not infer:
        return out.withColumn("inferred", F.lit(False)).withColumnRenamed("exact_code", "code")
    rules = timed.select("start", numbers.minutes(F.col("end")).alias("rule_end"), "ord", F.col("code").alias("near_code"))
    of_start = rules.groupBy("start").agg(F.collect_list(F.struct("rule_end", "ord", "near_code")).alias("_rules"))
    few = rules.limit(SMALL + 1).count() <= SMALL
    want = numbers.minutes(F.col("end"))
    rank = lambda r: F.struct((r["rule_end"] < want).cast("int").alias("short"), F.abs(r["rule_end"] - want).alias("far"), r["ord"].alias("ord"), r["near_code"].alias("near_code"))
    out = out.join(F.broadcast(of_start) if few else of_start, "start", "left")
    out = out.withColumn("near_code", F.when(F.col("exact_code").isNull(), F.array_min(F.transform("_rules", rank))["near_code"]))
    return out.select(
        *shifts.columns, F.coalesce("exact_code", "near_code").alias("code"),
        F.coalesce(F.when(F.col("exact_code").isNotNull(), F.col("validated")), F.lit(False)).alias("validated"),
        (F.col("exact_code").isNull() & F.col("near_code").isNotNull()).alias("inferred"),
    )


def spelled_codes(codes: DataFrame) -> DataFrame:
    """One row for each spelling (code and ``also``) in upper case, first rule first."""
    every = F.concat(F.array("code"), F.coalesce("also", F.array().cast("array<string>")))
    rows = codes.withColumn("spelling", F.explode(F.transform(every, lambda c: F.upper(F.trim(c))))).where("spelling <> ''")
    return keep_first(rows, ["spelling"], ["ord"])


def times_of_codes(rows: DataFrame, codes: DataFrame, code: str) -> DataFrame:
    """Left join on the upper-cased code or one of its ``also`` spellings: adds rule_start, rule_end, rule_code."""
    rules = spelled_codes(codes.where(~F.col("is_special"))).select("spelling", F.col("start").alias("rule_start"), F.col("end").alias("rule_end"), F.upper("code").alias("rule_code"))
    return rows.withColumn("_u", F.upper(F.trim(F.col(code)))).join(small(rules), F.col("_u") == F.col("spelling"), "left").drop("_u", "spelling")


def types_of_codes(rows: DataFrame, codes: DataFrame, aliases: DataFrame, code: str) -> DataFrame:
    """Adds ``duty_type`` through an alias, then the first rule that spells the code."""
    named = small(keep_first(aliases.withColumn("_from", F.upper("alias")), ["_from"], ["ord"]).select("_from", F.upper("target").alias("_to")))
    rules = small(spelled_codes(codes).select("spelling", F.lower(F.trim("type")).alias("duty_type")))
    out = rows.withColumn("_u", F.upper(F.trim(F.col(code)))).join(named, F.col("_u") == F.col("_from"), "left")
    out = out.withColumn("_u", F.coalesce("_to", "_u")).join(rules, F.col("_u") == F.col("spelling"), "left")
    return out.drop("_u", "_from", "_to", "spelling")


def override_unmapped(shifts: DataFrame, overrides: DataFrame, marker: str = "⚠️") -> DataFrame:
    """User codes replace the type of unmapped timed rows; overrides: (times, user_code)."""
    key = F.concat_ws("-", "start", "end")
    out = shifts.withColumn("_key", key).join(small(overrides), F.col("_key") == F.col("times"), "left")
    apply = F.col("user_code").isNotNull() & ~F.coalesce("all_day", F.lit(False)) & (F.col("type").startswith(marker) | F.col("type").contains(F.col("_key")))
    out = out.withColumn("_apply", F.coalesce(apply, F.lit(False)))
    out = out.withColumn("type", F.when(F.col("_apply"), F.col("user_code")).otherwise(F.col("type"))).withColumn("is_validated", F.when(F.col("_apply"), F.lit(False)).otherwise(F.col("is_validated")))
    return out.drop("_key", "times", "user_code", "_apply")


def chain_main_and_oncall(shifts: DataFrame, hops: int = 10) -> DataFrame:
    """Greedy chaining of main shifts with on-call rows that begin where they end.

    shifts: doc_id, seq, on_call, date, start, end. Main rows take on-call rows
    in order, each row once, at most ``hops``; a chain that ends at 00:00 goes
    on at 00:00 of the next day. Adds chain_seq (seq of the main row that took
    the row, else null) and chain_end. Order decides, so the rows of a document
    come sorted to one task; documents are small and independent."""

    one_day = timedelta(days=1)

    def chain(rows: list) -> list[tuple]:
        free: dict[tuple, list[int]] = {}
        for i, r in enumerate(rows):
            if r.on_call:
                free.setdefault((r.date, r.start), []).append(i)
        owner: list[int | None] = [None] * len(rows)
        ends: list[str | None] = [None] * len(rows)
        for i, r in enumerate(rows):
            if r.on_call or r.all_day:
                continue
            day, end, members = r.date, r.end, []
            for _ in range(hops):
                same = free.get((day, end)) or []
                over = (free.get((day + one_day, "00:00")) or []) if end == "00:00" else []
                nxt = min([x[0] for x in (same, over) if x], default=None)
                if nxt is None:
                    break
                if same and same[0] == nxt:
                    same.pop(0)
                else:
                    day += one_day
                    over.pop(0)
                members.append(nxt)
                end = rows[nxt].end
            if members:
                for j in [i, *members]:
                    owner[j], ends[j] = int(r.seq), end
        return [(r.doc_id, r.seq, o, e) for r, o, e in zip(rows, owner, ends, strict=True)]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        show = lambda out: pd.DataFrame(out, columns=["doc_id", "seq", "chain_seq", "chain_end"]).astype({"chain_seq": "Int64"})
        open_: list = []
        for part in parts:
            out = []
            for r in part.itertuples(index=False):
                if open_ and open_[0].doc_id != r.doc_id:
                    out += chain(open_)
                    open_ = []
                open_.append(r)
            yield show(out)
        yield show(chain(open_))

    spark = shifts.sparkSession
    ship(spark)
    kinds = dict(shifts.dtypes)
    rows = shifts.select("doc_id", "seq", "on_call", F.coalesce("all_day", F.lit(False)).alias("all_day"), "date", "start", "end")
    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id").sortWithinPartitions("doc_id", "seq")
    taken = dealt.mapInPandas(run, f"doc_id {kinds['doc_id']}, seq {kinds['seq']}, chain_seq long, chain_end string")
    return shifts.join(taken, ["doc_id", "seq"])


def contained_rules(days: DataFrame, rules: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """First rule (by ord) whose codes are among the day's codes and whose
    next-day codes are among the next day's, under its calendar predicate.

    days: keys, day, codes, is_free, is_friday, next_codes, next_is_free; rules:
    ord, id, when, codes, next_codes. Without consumption across days."""
    r = small(rules.select(*[F.col(c).alias(f"_{c}") for c in ("ord", "id", "when", "codes", "next_codes")]))
    when = (
        F.when(F.col("_when") == "weekday", ~F.col("is_free"))
        .when(F.col("_when") == "weekday-mon-thu", ~F.col("is_free") & ~F.col("is_friday"))
        .when(F.col("_when") == "friday", F.col("is_friday"))
        .when(F.col("_when") == "weekend-or-holiday", F.col("is_free"))
        .when(F.col("_when") == "next-day-weekend-or-holiday", F.col("next_is_free"))
        .when(F.col("_when") == "next-day-weekday", ~F.col("next_is_free"))
        .otherwise(F.lit(True))
    )
    inside = lambda need, have: F.size(F.array_except(need, have)) == 0
    on = when & inside(F.col("_codes"), F.col("codes")) & inside(F.coalesce("_next_codes", F.array().cast("array<string>")), F.col("next_codes"))
    found = days.join(r, on, "inner").groupBy(*keys, day).agg(F.min_by("_id", "_ord").alias("rule_id"))
    return days.join(found, [*keys, day], "left")


def best_fuzzy(left: DataFrame, right: DataFrame, left_name: str, right_name: str, right_id: str, block: Column, right_block: Column, least: float) -> DataFrame:
    """Best match of each left name within its block by edit similarity (ties: smallest right id), if at least ``least``.

    The block keeps candidate pairs to likely ones; it must be a property that true matches share.
    Equal names are compared once, by their smallest right id. A block is cut into tiles of about
    LEFT_NAMES by RIGHT_NAMES names, and each tile finds the nearest right name of each left one (nearest.tile)."""
    spark = left.sparkSession
    ship(spark)
    a = left.distinct().select("*", F.col(left_name).alias("_left"), block.alias("_block"))
    b = right.select(F.col(right_name).alias("_name"), F.col(right_id).alias("_id"), right_block.alias("_block")).where("_name IS NOT NULL").groupBy("_block", "_name").agg(F.min("_id").alias("_id"))
    names = a.where("_left IS NOT NULL").select("_block", "_left").distinct()
    cuts = lambda rows, most, to: rows.groupBy("_block").agg(F.ceil(F.count("*") / most).alias(to))
    grid = cuts(names, LEFT_NAMES, "_lefts").join(cuts(b, RIGHT_NAMES, "_rights"), "_block")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    names = names.join(grid, "_block").select("_block", own("_left", "_lefts").alias("_l"), each(F.col("_rights")).alias("_r"), "_left")
    others = b.join(grid, "_block").select("_block", each(F.col("_lefts")).alias("_l"), own("_name", "_rights").alias("_r"), "_name", "_id")
    keys, kinds = ("_block", "_l", "_r"), dict(names.dtypes) | dict(others.dtypes)
    tiles = spread(names, *keys).groupBy(*keys).cogroup(spread(others, *keys).groupBy(*keys))
    rows = tiles.applyInArrow(nearest.tile, ", ".join(f"{c} {kinds[c]}" for c in ("_block", "_left", "_name", "_id")))
    rows = rows.withColumn("_score", similarity(F.col("_left"), F.col("_name"))).where(F.col("_score") >= least)
    best = rows.groupBy("_block", "_left").agg(F.max_by(F.struct("_id", "_name", "_score"), F.struct("_score", -F.col("_id"))).alias("m"))
    return a.join(best, ["_block", "_left"]).select(*left.columns, F.col("m._id").alias("match_id"), F.col("m._name").alias("match_name"), F.col("m._score").alias("score"))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 0 if either is empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def range_join(points: DataFrame, bands: DataFrame, value: str, low: str, high: str, width: float, keys: Sequence[str] = (), how: str = "inner") -> DataFrame:
    """Points in half-open bands [low, high): an equi-join on buckets of ``width`` (a band is repeated in the buckets that it covers), then the exact test."""
    bucket = lambda c: F.floor(c / F.lit(float(width))).cast("long")
    p = points.withColumn("_b", bucket(F.col(value)))
    b = small(bands.where(F.col(high) > F.col(low))).withColumn("_b", F.explode(F.sequence(bucket(F.col(low)), bucket(F.col(high)))))
    other = b.select(*[F.col(k).alias(f"_{k}") for k in (*keys, "_b")], *[c for c in bands.columns if c not in keys])
    on = (p["_b"] == other["__b"]) & (p[value] >= other[low]) & (p[value] < other[high])
    for k in keys:
        on = on & (p[k] == other[f"_{k}"])
    return p.join(other, on, how).drop("_b", "__b", *[f"_{k}" for k in keys])


def best_overlap(tokens: DataFrame, columns: DataFrame, page: str, token: str, slack: float = 0.0) -> DataFrame:
    """Column of each token box by the largest horizontal overlap (ties to the
    right); a token that overlaps none goes to the nearest centre.

    tokens: page, token, x, w; columns: page, day_idx, x0, x1. A page has a
    few dozen columns, so the join on the page is bounded by them."""
    c = columns.select(page, "day_idx", F.col("x0").alias("_x0"), F.col("x1").alias("_x1"))
    over = F.least(F.col("x") + F.col("w"), F.col("_x1") + slack) - F.greatest(F.col("x"), F.col("_x0") - slack)
    far = F.abs(F.col("x") + F.col("w") / 2 - (F.col("_x0") + F.col("_x1")) / 2)
    rows = tokens.join(c, page, "left").withColumn("_o", F.greatest(over, F.lit(0.0))).withColumn("_f", -far)
    rank = F.struct("_o", F.when(F.col("_o") > 0, F.lit(0.0)).otherwise(F.col("_f")).alias("_f"), "day_idx")
    own = [F.any_value(k).alias(k) for k in tokens.columns if k not in (page, token)]
    return rows.groupBy(page, token).agg(*own, F.max_by("day_idx", rank).alias("day_idx"))


def layered(rows: DataFrame, layers: Sequence[DataFrame], keys: Sequence[Sequence[str]], values: Sequence[str]) -> DataFrame:
    """Scope override: the value of the most specific layer that has one (layers from specific to general)."""
    out = rows
    for i, (layer, on) in enumerate(zip(layers, keys, strict=True)):
        out = out.join(small(layer.select(*on, *[F.col(v).alias(f"_{v}_{i}") for v in values])), list(on), "left")
    picked = [F.coalesce(*[F.col(f"_{v}_{i}") for i in range(len(layers))]).alias(v) for v in values]
    return out.select(*rows.columns, *picked)


def outer_compare(expected: DataFrame, actual: DataFrame, keys: Sequence[str], expected_value: str, actual_value: str, tolerance: float = 0.02) -> DataFrame:
    """Full outer reconciliation: both values, their difference in cents, and whether it is within tolerance; null if one side is missing."""
    out = expected.join(actual, list(keys), "full_outer")
    delta = numbers.cents(F.col(actual_value) - F.col(expected_value))
    return out.withColumn("delta", delta).withColumn("ok", F.abs(F.col(actual_value) - F.col(expected_value)) < tolerance)


def tenant_filter(rows: DataFrame, column: str, tenant: str | None) -> DataFrame:
    """Rows of the tenant, and rows that name none."""
    return rows if tenant is None else rows.where(F.col(column).isNull() | (F.col(column) == tenant))


def keep_all_unless_hit(rows: DataFrame, keys: Sequence[str], hit: Column, strict: bool = True) -> DataFrame:
    """Rows with a hit; where a key has none: nothing, or (not strict) all its rows, as older tools did."""
    if strict:
        return rows.where(hit)
    any_hit = F.max(hit.cast("int")).over(Window.partitionBy(*keys))
    return rows.withColumn("_any", any_hit).where((F.col("_any") == 0) | hit).drop("_any")
