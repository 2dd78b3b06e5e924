"""What each filter removes in each order of the filters, by part of the corpus.

Four filters look at one text; the fifth (an equal text with a smaller doc_id)
looks at all. Equal texts are found by partition refinement: documents are split
by code-point length, then by the hash of one block of the text after the other
(blocks grow eightfold, so a text has few), and whoever is alone in its class
leaves. A class is XXH64 of the block with the class before as its seed, so it is
one number. The full texts of what is left are compared as grouping keys, and
all but the smallest ids are marked. Rounds work on narrow rows; texts are read
twice and only those of classes that stay are shuffled.

Every document is then one of 32 masks. What a filter removes after a set of
others depends on masks alone, so the 120 orders are looked up in 80 sums for
each part.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bloom
from . import kernels as K
from .common import arrow, salted, stored

FILTERS = "ABCDE"
LEAST_WORDS = 200
DISTINCT_PERCENT = 50
CAPITAL_PERCENT = 2
SYMBOLS = b"#$%&*|"
BLOCK, GROWTH = 64, 8
_CAPITALS = bytes(range(65, 91))
_TAILS = bytes(range(0x80, 0xC0))
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def code_points(data: bytes) -> int:
    return len(data.translate(None, _TAILS))


def words(data: bytes, piece: int = 1 << 22) -> tuple[int, int]:
    """Words and distinct words; a long text is looked at in pieces."""
    count, seen, at = 0, set(), 0
    while at < len(data):
        gap = _SPACE.search(data, at + piece) if at + piece < len(data) else None
        end = gap.end() if gap else len(data)
        own = data[at:end].split()
        seen.update(own)
        count, at = count + len(own), end
    return count, len(seen)


def mask_of(data: bytes) -> int:
    """Bits of the filters A to D that the text fails."""
    n, distinct = words(data)
    fails = (
        n < LEAST_WORDS,
        100 * distinct < DISTINCT_PERCENT * n,
        100 * (len(data) - len(data.translate(None, _CAPITALS))) > CAPITAL_PERCENT * code_points(data),
        len(data.translate(None, SYMBOLS)) < len(data),
    )
    return sum(1 << i for i, fail in enumerate(fails) if fail)


def refined(data: bytes) -> list[int]:
    """The classes of a text from coarse to fine: its length in code points, then after each block."""
    length = code_points(data)
    text = data if length == len(data) else data.decode()
    out, lo, hi = [length], 0, BLOCK
    while lo < length:
        block = text[lo:hi] if isinstance(text, bytes) else text[lo:hi].encode()
        out.append(xxhash.xxh64_intdigest(block, out[-1]))
        lo, hi = hi, hi * GROWTH
    return out


def _bytes(column: pa.Array) -> Iterator[bytes]:
    data, offs = K.buffers(column)
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        yield data[a:b].tobytes()


def _judged(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask and classes of every document."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks, ends, flat = [], [0], []
            for data in _bytes(batch.column("text")):
                masks.append(mask_of(data))
                flat += refined(data)
                ends.append(len(flat))
            classes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(flat, K.U).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(masks, pa.int32()), classes], ["doc_id", "part", "mask", "classes"])

    source = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), "text")
    return stored(arrow(source, mapped, f"doc_id {dict(docs.dtypes)['doc_id']}, part string, mask int, classes array<long>"), "audit-judged")


def survivors(judged: DataFrame) -> DataFrame | None:
    """doc_id, part, mask and class of the documents that are never alone in
    their class, round by round; None if there are none. A round counts its
    classes (summed within tasks first) and drops those of one row."""
    rounds = judged.agg(F.max(F.size("classes"))).first()[0] or 0
    live, done = judged, []
    for k in range(rounds):
        now = live.withColumn("class", F.element_at("classes", k + 1))
        shared = now.groupBy("class").agg(F.count("*").alias("n")).where("n > 1").drop("n")
        live = stored(salted(now, shared, ["class"], F.col("doc_id")), "audit-round")
        done.append(live.where(F.size("classes") == k + 1).drop("classes"))
        live = live.where(F.size("classes") > k + 1).drop("class")
        if not live.limit(1).count():
            break
    out = None
    for some in done:
        out = some if out is None else out.unionByName(some)
    return out


def copies(docs: DataFrame, judged: DataFrame) -> DataFrame | None:
    """doc_id, part and mask of every document whose full text a smaller doc_id has as well."""
    left = survivors(judged)
    made = None if left is None else bloom.build(left.select("class").distinct(), "class")
    if made is None:
        return None
    shared = docs.sparkSession.sparkContext.broadcast(made)  # 64 MB at most

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = np.array([refined(data)[-1] for data in _bytes(batch.column("text"))], K.U).view(np.int64)
            hit = pa.array(np.flatnonzero(shared.value.holds(last)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(hit), pa.array(last).take(hit), batch.column("text").take(hit)], ["doc_id", "class", "text"])

    texts = arrow(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), mapped, f"doc_id {dict(docs.dtypes)['doc_id']}, class long, text string")
    # whole texts are the grouping key, so texts that only share hashes stay apart
    first = texts.groupBy("class", "text").agg(F.min("doc_id").alias("doc_id")).select("class", "doc_id")
    return left.where("doc_id is not null").join(first, ["class", "doc_id"], "left_anti").select("doc_id", "part", "mask")


def orders() -> list[tuple[str, int, int, int]]:
    """(filter_order, step, mask of the filters before, bit of the filter) of all orders."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            out.append(("".join(order), step, before, bit))
            before |= bit
    return out


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (bit i: fails filter i), n, good and toxic documents."""
    judged = _judged(docs)
    again = copies(docs, judged)
    moved = judged.select("doc_id", "part", "mask", F.lit(1).alias("n"))
    if again is not None:
        moved = moved.unionByName(again.withColumn("n", F.lit(-1))).unionByName(again.select("doc_id", "part", (F.col("mask") + 16).alias("mask"), F.lit(1).alias("n")))
    # summed by document first: however often an id repeats, it meets its labels in few rows
    by_id = moved.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n")).where("n <> 0")
    known = labels.groupBy(F.col("doc_id").alias("_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    both = by_id.join(known, F.col("doc_id") == F.col("_id"), "left")
    count = lambda c: F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c)
    return both.groupBy("part", "mask").agg(F.sum("n").alias("n"), count("good"), count("toxic"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, filter order and step: documents kept after the
    step, removed by it, redundant (failing its filter, removed before),
    unique_fails (failing its filter only), good_lost and toxic_lost among the
    removed, and shapley (what its filter removes, summed over all orders).

    A null text is empty, a null source is the part of empty name (with rows that
    have it), a null doc_id takes part but is never a copy nor makes one, equal
    rows (id and text) are no copies of each other, labels count if any row of an
    id has them, and documents without labels are neither good nor toxic. An empty
    table gives no rows; very long texts are read in pieces and blocks; other
    columns are ignored."""
    spark = docs.sparkSession
    sums = stored(masks(docs, labels), "audit-masks")
    places = range(len(FILTERS))
    subsets = [(s, 1 << f) for f in places for s in range(1 << len(FILTERS)) if not s >> f & 1]
    cases = F.array(*[F.struct(F.lit(s).alias("before"), F.lit(f).alias("bit")) for s, f in subsets])
    rows = sums.select("part", "mask", "n", "good", "toxic", F.explode(cases).alias("c")).select("part", "mask", "n", "good", "toxic", "c.before", "c.bit")
    fails = F.col("mask").bitwiseAND(F.col("bit")) != 0
    open_ = F.col("mask").bitwiseAND(F.col("before")) == 0
    total = lambda when, what, name: F.sum(F.when(when, F.col(what)).otherwise(F.lit(0))).alias(name)
    told = rows.groupBy("part", "before", "bit").agg(
        total(open_ & ~fails, "n", "kept"),
        total(open_ & fails, "n", "removed"),
        total(~open_ & fails, "n", "redundant"),
        total(F.col("mask") == F.col("bit"), "n", "unique_fails"),
        total(open_ & fails, "good", "good_lost"),
        total(open_ & fails, "toxic", "toxic_lost"),
    )
    # a set of k filters stands before the filter in k! * (4 - k)! orders
    ways = F.element_at(F.array(*[F.lit(math.factorial(k) * math.factorial(len(FILTERS) - 1 - k)) for k in places]), F.bit_count("before") + 1)
    told = told.withColumn("shapley", F.sum(F.col("removed") * ways).over(Window.partitionBy("part", "bit")))
    table = spark.createDataFrame(orders(), "filter_order string, step int, before int, bit int")  # 600 rows
    return told.join(F.broadcast(table), ["before", "bit"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
