"""Set operations: partition-overwrite merge, upserts, union, deletes."""

from __future__ import annotations

from collections.abc import Sequence
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sequences import keep_first

IDENTITY = ("workplace_id", "date", "start", "end", "type")


class Mode(Enum):
    """What a batch does to its tenant's older rows."""

    PRESERVE = "preserve"  # replaces the months that it brings, keeps others
    APPEND = "append"  # keeps all
    REPLACE = "replace"  # keeps none


def overwrite_merge(base: DataFrame, new: DataFrame, tenant: str, months: DataFrame | None = None, mode: Mode = Mode.PRESERVE) -> DataFrame:
    """Other tenants' rows, the tenant's (and untagged) rows that stay, and the
    new rows, the first of each identity kept.

    months: (ym) that the batch replaces, by default those of the new rows; a
    month without a new row is named by an artifact with data only. A batch
    without months (CSV, ICS) that preserves is an append: it never wipes the
    tenant. An empty batch changes nothing. base and new: with src_seq."""
    tagged = new.withColumn("workplace_id", F.lit(tenant))
    months = tagged.select(F.date_format("date", "yyyy-MM").alias("ym")) if months is None else months.select("ym")
    mine = F.coalesce(F.col("workplace_id"), F.lit(tenant)) == tenant
    others, own = base.where(~mine), base.where(mine)
    some = tagged.limit(1).agg((F.count("*") > 0).alias("_some"))  # one row
    if mode is Mode.PRESERVE:
        kept = own.join(F.broadcast(months.distinct().withColumnRenamed("ym", "_ym")), F.date_format("date", "yyyy-MM") == F.col("_ym"), "left_anti")
    elif mode is Mode.APPEND:
        kept = own
    else:
        kept = own.join(F.broadcast(some), ~F.col("_some"), "left_semi")
    return dedupe(others.withColumn("_part", F.lit(0)).unionByName(kept.withColumn("_part", F.lit(1))).unionByName(tagged.withColumn("_part", F.lit(2)), allowMissingColumns=True))


def dedupe(rows: DataFrame, keys: Sequence[str] = IDENTITY) -> DataFrame:
    """Keep-first by identity in (_part, src_seq) order; a null part of the key equals an empty one, tagged and untagged rows differ."""
    named = rows
    for k in keys:
        named = named.withColumn(f"_k_{k}", F.coalesce(F.col(k).cast("string"), F.lit("")))
    return keep_first(named, [f"_k_{k}" for k in keys], ["_part", "src_seq"]).drop("_part", *[f"_k_{k}" for k in keys])


def upsert(base: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows, and base rows whose key they do not have."""
    return base.join(new.select(*keys), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def merge_summaries(base: DataFrame, new: DataFrame, months: DataFrame) -> DataFrame:
    """Summaries of other months stay, and those whose month cannot be read."""
    number = lambda c: F.expr(f"try_cast({c} AS INT)")
    key = F.format_string("%04d-%02d", number("year"), number("month"))
    readable = (F.coalesce(number("month"), F.lit(0)) > 0) & (F.coalesce(number("year"), F.lit(0)) > 0)
    stay = base.withColumn("_ym", F.when(readable, key)).join(months.select(F.col("ym").alias("_m")), F.col("_ym") == F.col("_m"), "left_anti")
    return stay.drop("_ym").unionByName(new, allowMissingColumns=True)


def delete_tenant(rows: DataFrame, tenant: str) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, one row with ``removed``): the tenant's rows go, and untagged ones."""
    gone = F.coalesce(F.col("workplace_id"), F.lit(tenant)) == tenant
    return rows.where(~gone), rows.agg(F.count_if(gone).alias("removed"))


def not_held(requested: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """Requested keys that are not held yet."""
    return requested.join(held.select(key), key, "left_anti")
