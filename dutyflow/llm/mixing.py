"""Mixing sources to target weights by hash-threshold histograms (built-in functions only).

Each document has a fixed 48-bit hash. A source's budget is met by taking all
documents below a hash threshold once more than the rest. The threshold comes
from histograms of words by source and hash bucket: the first level covers the
whole hash range, each later level only the bucket in which the budget ends.
Nothing is sorted by document, thresholds of smaller budgets are nested in
those of larger ones, and the join that applies them is keyed by source and
bucket, so that a source with a third of all rows is spread over 1024 keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import same_keys, stored

WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2.0
BITS = (10, 19, 19)
TOTAL_BITS = sum(BITS)
BROADCAST_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of maximal runs without ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def document_hash(doc_id: Column, text: Column) -> Column:
    """The first 48 bits of the MD5 of the id as text, a colon and the text."""
    both = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(both), 1, TOTAL_BITS // 4), 16, 10).cast("long")


def targets(sources: DataFrame, share: float = SHARE, cap: float = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) -> with ``target``: water-filling of share x all
    sizes by weight, each target at most cap x its source. One row for each
    source, so the windows see pre-aggregated rows only."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_room = Window.orderBy("room", F.col("source").asc_nulls_last())
    upto = by_room.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sources.withColumn("w", w).withColumn("top", F.col("source_size") * F.lit(cap))
    rows = rows.withColumn("room", F.col("top") / F.col("w")).withColumn("budget", F.sum("source_size").over(every) * F.lit(share))
    rows = rows.withColumn("order", F.row_number().over(by_room))
    rows = rows.withColumn("level", (F.col("budget") - (F.sum("top").over(upto) - F.col("top"))) / (F.sum("w").over(every) - (F.sum("w").over(upto) - F.col("w"))))
    level = F.min_by(F.when(F.col("level") <= F.col("room"), F.col("level")), F.when(F.col("level") <= F.col("room"), F.col("order"))).over(every)
    return rows.withColumn("flat", level).select("source", "source_size", F.least(F.coalesce(F.col("flat") * F.col("w"), F.col("top")), F.col("top")).alias("target"))


def _plan(narrow: DataFrame, nested: tuple[float, ...], share: float, cap: float, weights: tuple[int, ...]) -> tuple[DataFrame, DataFrame]:
    """One row per source (source, source_size, target, cuts: copies of all and
    hash end of one copy more, for each fraction), and the first histogram."""
    first = stored(narrow.groupBy("source", F.shiftright("h", TOTAL_BITS - BITS[0]).alias("b")).agg(F.sum("size").alias("words")), "mix-histogram")
    goal = stored(targets(first.groupBy("source").agg(F.sum("words").alias("source_size")), share, cap, weights), "mix-targets")
    part = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(f)).alias("f")) for k, f in enumerate(nested)]))
    budgets = goal.withColumn("p", part).select("source", "source_size", F.col("p.k").alias("k"), (F.col("target") * F.col("p.f")).alias("budget"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    budgets = budgets.withColumn("base", whole).withColumn("left", F.col("budget") - F.col("base") * F.col("source_size"))
    left, shift = budgets.select("source", "k", "left"), TOTAL_BITS
    for i, bits in enumerate(BITS):
        before, shift = shift, shift - bits
        if i == 0:
            hist = same_keys(first, left, ["source"])
        else:
            inside = same_keys(narrow.withColumn("b", F.shiftright("h", before)), left, ["source", "b"])
            hist = inside.groupBy("source", "k", "left", F.shiftright("h", shift).alias("b")).agg(F.sum("size").alias("words"))
        running = F.sum("words").over(Window.partitionBy("source", "k").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        hist = hist.withColumn("upto", running).withColumn("over", F.col("left") - (F.col("upto") - F.col("words")))
        if shift:
            left = hist.where((F.col("upto") > F.col("left")) & (F.col("over") >= 0)).select("source", "k", "b", F.col("over").alias("left"))
            left = stored(left, "mix-boundary")
    # a last bucket is one hash: it is taken if that brings the sum nearer
    taken = hist.where(F.col("words") / 2 <= F.col("over")).groupBy("source", "k").agg((F.max("b") + 1).alias("end"))
    ends = same_keys(left.select("source", "k", F.shiftleft("b", BITS[-1]).alias("start")), taken, ["source", "k"], "left")
    ends = same_keys(budgets, ends, ["source", "k"], "left").withColumn("end", F.when(F.col("left") > 0, F.coalesce("end", "start", F.lit(1 << TOTAL_BITS))).otherwise(F.lit(0)))
    cuts = ends.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("k", "base", "end"))).alias("cuts"))
    return stored(same_keys(goal, cuts, ["source"]), "mix-plan"), first


def _with_copies(rows: DataFrame, plan: DataFrame, first: DataFrame) -> DataFrame:
    """rows: with source and h. The plan has one row per source and is broadcast
    if there are at most BROADCAST_SOURCES; else rows meet it by source and
    bucket, which spreads a hot source over 1024 keys."""
    if plan.count() <= BROADCAST_SOURCES:
        out = same_keys(rows, F.broadcast(plan), ["source"])
    else:
        wide = same_keys(first.select("source", "b"), plan, ["source"])
        out = same_keys(rows.withColumn("b", F.shiftright("h", TOTAL_BITS - BITS[0])), wide, ["source", "b"]).drop("b")
    return out.withColumn("copies", F.transform("cuts", lambda c: c["base"] + (F.col("h") < c["end"]).cast("int"))).drop("cuts")


def _narrow(docs: DataFrame) -> DataFrame:
    return stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), document_hash(F.col("doc_id"), F.col("text")).alias("h")), "mix")


def mix(docs: DataFrame, nested: tuple[float, ...] = (1.0,), share: float = SHARE, cap: float = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, and
    ``copies`` (array<int>): how often the mix repeats the document at each of
    the ``nested`` fractions of the targets (ascending; copies never fall).

    Null text has size 0, a null source is a source of its own, rows equal in
    doc_id and text share a hash and so a fate (ids alone may be null or repeat),
    an empty table gives no rows, very long texts are counted where they stand.
    Other columns are ignored."""
    narrow = _narrow(docs)
    return _with_copies(narrow, *_plan(narrow, nested, share, cap, weights)).drop("h")


def mixed(docs: DataFrame, share: float = SHARE, cap: float = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The documents of the mix themselves, each as often as the mix takes it,
    with the columns of ``docs``. Edge cases are as in mix()."""
    plan, first = _plan(_narrow(docs), (1.0,), share, cap, weights)
    own = docs.select(F.struct(*docs.columns).alias("d"), "source", document_hash(F.col("doc_id"), F.col("text")).alias("h"))
    out = _with_copies(own, plan, first).withColumn("copies", F.element_at("copies", 1)).where("copies > 0")
    return out.select("d", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("d.*")
