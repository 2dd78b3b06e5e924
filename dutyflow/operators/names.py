"""Person names on rosters: detection, fuzzy choice, saved spellings, rows of a person."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .lookups import similarity, small
from .sequences import keep_first

FOUND, SHOWN = 0.65, 0.8


def candidates(tokens: DataFrame) -> DataFrame:
    """(page_id, key, label, y_center, height): plausible names in the left third of each page, the first token of each key."""
    width = tokens.groupBy("page_id").agg(F.max(F.col("x") + F.col("w")).alias("_width"))
    label = F.trim(F.regexp_replace("text", r"\s+", " "))
    rows = tokens.join(width, "page_id").withColumn("label", label).where((F.col("x") <= F.col("_width") * 0.34) & (F.length("label") <= 56) & text.plausible_person(F.col("label")))
    rows = rows.withColumn("key", text.name_key(F.col("label"))).where("key <> ''")
    return keep_first(rows, ["page_id", "key"], ["y", "token_id"]).select("page_id", "key", "label", (F.col("y") + F.col("h") / 2).alias("y_center"), F.col("h").alias("height"))


def people_by_surname(names: DataFrame) -> DataFrame:
    """(page_id, surname, people): distinct people, titles aside."""
    rows = names.select("page_id", text.surname(F.col("key")).alias("surname"), F.array_join(text.given_names(F.col("key")), " ").alias("given")).where("surname <> ''")
    return rows.groupBy("page_id", "surname").agg(F.count_distinct("given").alias("people"))


def _best_token(a: Column, b: Column) -> Column:
    """The best similarity of a token of a with one of b; 0 if either has none."""
    per = F.transform(a, lambda x: F.coalesce(F.array_max(F.transform(b, lambda y: similarity(x, y))), F.lit(0.0)))
    return F.coalesce(F.array_max(per), F.lit(0.0))


def scored(names: DataFrame, preferred: str, aliases: DataFrame | None = None) -> DataFrame:
    """Adds ``score`` of each candidate for a preferred name: a ladder of rules
    from equal keys over near surnames and given names to shared tokens.

    aliases: (alias, target) of spellings that the user confirmed."""
    key, want = F.col("key"), text.name_key(F.lit(preferred))
    counts = people_by_surname(names)
    rows = names.withColumn("surname", text.surname(key)).join(counts, ["page_id", "surname"], "left")
    if aliases is None:
        rows = rows.withColumn("_alias", F.lit(None).cast("string"))
    else:
        known = keep_first(aliases.select(text.name_key(F.col("alias")).alias("key"), text.name_key(F.col("target")).alias("_alias")), ["key"], ["_alias"])
        rows = rows.join(small(known), "key", "left")
    sur, given = F.col("surname"), text.given_names(key)
    pref_sur, pref_given = text.surname(want), text.given_names(want)
    near, near_given = similarity(pref_sur, sur), _best_token(pref_given, given)
    tokens = lambda k: F.array_distinct(F.filter(F.split(text.without_titles(k), r"[,\s]+"), lambda t: t != ""))
    shared = F.size(F.array_intersect(tokens(key), tokens(want)))
    same = (pref_sur != "") & (pref_sur == sur)
    lone = (same | (near >= 0.92)) & ((F.size(pref_given) == 0) | (F.size(given) == 0)) & (F.col("people") == 1)
    score = (
        F.when((key == want) | (text.without_titles(key) == want) | (F.col("_alias") == want), 1.0)
        .when((near >= 0.85) & (near_given >= 0.75), 0.95)
        .when((near >= 0.8) & (near_given >= 0.65), 0.9)
        .when((near >= 0.9) & (near_given >= 0.5), 0.88)
        .when(same & (key.contains(want) | want.contains(key)), 0.9)
        .when(lone, 0.9)
        .when(same, F.when(shared >= 2, 0.85).otherwise(0.65))
        .when((near >= 0.75) & (near_given >= 0.55), 0.8)
        .when(shared >= 2, 0.5)
        .when(shared == 1, 0.35)
        .otherwise(0.0)
    )
    return rows.withColumn("score", score).drop("people", "_alias", "surname")


def choose(names: DataFrame, preferred: str, aliases: DataFrame | None = None) -> DataFrame:
    """The best candidate of each page (the upper of equal ones) with a score of FOUND or more."""
    rows = scored(names, preferred, aliases).where(F.col("score") >= FOUND)
    return keep_first(rows, ["page_id"], [F.desc("score"), "y_center", "key"])


def all_matches(names: DataFrame, preferred: str, aliases: DataFrame | None = None, least: float = SHOWN) -> DataFrame:
    return scored(names, preferred, aliases).where(F.col("score") >= least)


def respelled(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """Labels in the saved spelling; the key stays, so rows are still found."""
    known = keep_first(aliases.select(text.name_key(F.col("alias")).alias("key"), "target"), ["key"], ["target"])
    return names.join(small(known), "key", "left").withColumn("label", F.coalesce("target", "label")).drop("target")


def person_rows(tokens: DataFrame, chosen: DataFrame) -> DataFrame:
    """(page_id, row_text): tokens on the line of the chosen person, from left to right."""
    rows = tokens.join(chosen.select("page_id", "y_center", "height"), "page_id").where(F.abs(F.col("y") + F.col("h") / 2 - F.col("y_center")) <= F.greatest(F.col("height"), F.col("h")) * 0.6)
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "text"))), lambda t: t["text"]), " ")
    return rows.groupBy("page_id").agg(words.alias("row_text"))


def quality(names: DataFrame) -> DataFrame:
    """Counts of labels that are plausible people, and of junk, by page."""
    good = text.plausible_person(F.col("label"))
    return names.groupBy("page_id").agg(F.count_if(good).alias("people"), F.count_if(~good).alias("junk"))
