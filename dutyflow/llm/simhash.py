"""Near duplicates by SimHash fingerprints and pigeonhole blocks.

Texts give 64-bit fingerprints (numpy, in Arrow batches); everything after works
on distinct fingerprints, so copies cost one row. The 64 bits are cut into four
blocks: two fingerprints that differ in two bits at most agree in two whole
blocks, so each is dealt to the six choices of two blocks and joined with those
that agree there. A block key that more than TOGETHER fingerprints share is cut
again by the same principle: its free bits make three parts, of which one agrees
as well. After three cuts nine bits are free, so 512 distinct fingerprints at
most share a key: groups are bounded whatever the data are, and none is dropped.
Within a key the Hamming distance of the members is computed, and a spanning
forest of the links leaves the task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import arrow, salted, stored, unused
from .neardup import _groups as grouped
from .neardup import components

RUN = 3
SEED = 42
DISTANCE = 2
BLOCKS, AGREE = 4, 2
CUTS = 3
TOGETHER = 1024
PAIRED = 4
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_HASHES = 1 << 16


def shingles(data: bytes, run: int = RUN, piece: int = K.PIECE) -> Iterator[list[bytes]]:
    """All runs of ``run`` lower-cased words of a text, joined by blanks, in lists
    of one piece of the text each; a text of fewer words gives one run of all."""
    carry: list[bytes] = []
    at, count = 0, 0
    while at < len(data):
        cut = _SPACE.search(data, at + piece) if at + piece < len(data) else None
        end = cut.end() if cut else len(data)
        own = data[at:end].lower().split()
        words, at, count = carry + own, end, count + len(own)
        if len(words) >= run:
            yield [b" ".join(x) for x in zip(*(words[i:] for i in range(run)), strict=False)]
        carry = words[-(run - 1) :] if run > 1 else []
    if 0 < count < run:
        yield [b" ".join(carry)]


def fingerprints(data: np.ndarray, offs: np.ndarray, run: int = RUN) -> np.ndarray:
    """The fingerprint of each text (unsigned): a bit is set if it is set in over
    half of the XXH64 hashes of its shingles; zero without a word."""
    n = len(offs) - 1
    ones, total = np.zeros((n, 64), np.int64), np.zeros(n, np.int64)
    hashes: list[int] = []
    owners: list[tuple[int, int]] = []

    def counted() -> None:
        if hashes:
            bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
            starts = np.array([at for _, at in owners])
            np.add.at(ones, [row for row, _ in owners], np.add.reduceat(bits, starts, axis=0, dtype=np.int64))
            hashes.clear()
            owners.clear()

    for row in range(n):
        for some in shingles(data[offs[row] : offs[row + 1]].tobytes(), run):
            owners.append((row, len(hashes)))
            hashes.extend(map(xxhash.xxh64_intdigest, some, repeat(SEED)))
            total[row] += len(some)
            if len(hashes) >= _HASHES:
                counted()
    counted()
    return np.packbits(2 * ones > total[:, None], axis=1).view(">u8").reshape(n).astype(K.U)


def printed(docs: DataFrame, column: str, run: int = RUN) -> DataFrame:
    """The documents with their fingerprint (long, signed) in ``column``; null text counts as empty."""
    names = [*docs.columns, column]

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = K.buffers(batch.column("text"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fingerprints(data, offs, run).view(np.int64))], names)

    return arrow(docs, mapped, ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes), f"`{column}` long"]))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def masks(blocks: int = BLOCKS, agree: int = AGREE) -> list[int]:
    """Bits of each choice of ``agree`` blocks out of ``blocks`` (unsigned)."""
    width = 64 // blocks
    return [sum(((1 << width) - 1) << (width * b) for b in chosen) for chosen in combinations(range(blocks), agree)]


def narrower(mask: int, parts: int = DISTANCE + 1) -> list[int]:
    """The mask with one more of ``parts`` parts of its free bits, for each part."""
    free = [b for b in range(64) if not mask >> b & 1]
    cut = [free[len(free) * i // parts : len(free) * (i + 1) // parts] for i in range(parts)]
    return [mask | sum(1 << b for b in part) for part in cut]


def forest(fp: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) that join all fingerprints within ``distance``, one for each but the roots."""
    left, right, open_ = [], [], np.ones(len(fp), bool)
    for root in range(len(fp)):
        if not open_[root]:
            continue
        open_[root], queue = False, [root]
        while queue and open_.any():
            i = queue.pop()
            rest = np.flatnonzero(open_)
            near = rest[np.bitwise_count(fp[rest] ^ fp[i]) <= distance]
            open_[near] = False
            left += [i] * len(near)
            right += near.tolist()
            queue += near.tolist()
    return np.array(left, np.int64), np.array(right, np.int64)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the members of each (mask, key); rows come sorted by these."""
    for rows, cut in grouped(batches, ["mask", "key"]):
        value = rows.column("fp").to_numpy()
        fp, size = value.view(K.U), np.diff(cut)
        few = np.repeat((size > 1) & (size <= PAIRED), size)
        end = np.repeat(cut[1:], size)
        one, other = [], []
        for step in range(1, PAIRED):
            i = np.flatnonzero(few[: len(fp) - step])
            i = i[i + step < end[i]]
            i = i[np.bitwise_count(fp[i] ^ fp[i + step]) <= DISTANCE]
            one.append(i)
            other.append(i + step)
        for k in np.flatnonzero(size > PAIRED):
            a, b = forest(fp[cut[k] : cut[k + 1]])
            one.append(cut[k] + a)
            other.append(cut[k] + b)
        a, b = np.concatenate(one), np.concatenate(other)
        yield pa.RecordBatch.from_arrays([pa.array(value[a]), pa.array(value[b])], ["a", "b"])


def links(prints: DataFrame) -> DataFrame:
    """(a, b): links that join all fingerprints of ``prints`` (fp, distinct)
    within DISTANCE bits, directly or by others; at most a forest for each key."""
    level = masks()
    rows = prints.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in level])).alias("mask"))
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found: list[DataFrame] = []
    for cut in range(CUTS + 1):
        keyed = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
        met = stored(salted(keyed, sizes, ["mask", "key"], F.col("fp")), "sim-blocks")
        small = met.where(F.col("n") <= TOGETHER) if cut < CUTS else met
        dealt = small.select("mask", "key", "fp").repartition(parts, "mask", "key").sortWithinPartitions("mask", "key")
        found.append(stored(arrow(dealt, _linked, "a long, b long").distinct(), "sim-links"))
        large = met.where(F.col("n") > TOGETHER)
        if cut == CUTS or not large.limit(1).count():
            break
        children = {m: narrower(m) for m in level}
        level = list(dict.fromkeys(c for three in children.values() for c in three))
        chosen: Column = F.create_map(*[x for m, three in children.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(c)) for c in three]))])
        rows = large.select("fp", F.explode(F.element_at(chosen, F.col("mask"))).alias("mask")).distinct()
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _named(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of every row, and (fp, label, rep) of every distinct fingerprint."""
    rows = stored(printed(docs.select("doc_id", "text"), "fp").drop("text"), "sim-prints")
    prints = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "sim-distinct")
    labels = components(links(prints.select("fp"))).withColumnRenamed("node", "fp")
    return rows, prints.join(labels, "fp", "left").select("fp", "rep", F.coalesce("label", "fp").alias("label"))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row:
    fingerprints link at DISTANCE or fewer differing bits, and component_id is
    the smallest doc_id that links reach, the row's own included.

    Words are lower-cased (A-Z) runs without ASCII white space; a text of fewer
    than RUN words is one shingle, and null, empty or blank texts have
    fingerprint zero, which links like any other. Repeated rows get equal
    results; a null doc_id takes part and stands for its component only if all
    its ids are null. An empty table gives no rows; a very long text is hashed in
    pieces; other columns are ignored."""
    rows, named = _named(docs)
    lowest = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    ids = salted(named.select("fp", "label"), lowest, ["label"], F.col("fp")).select("fp", "component_id")
    both = salted(rows, ids, ["fp"], F.col("doc_id"))
    return both.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def kept(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, that stand for their component: the
    row of its smallest doc_id (of repeated or null ids the one with the smallest
    fingerprint; of rows equal in both any one). Edge cases are as in classes()."""
    _, named = _named(docs)
    order = F.struct(F.col("rep").isNull(), "rep", "fp")
    stay = named.groupBy("label").agg(F.min(order).alias("first")).select(F.col("first.rep").alias("_rep"), F.col("first.fp").alias("_own"))
    mark = unused(docs, "_fp")
    own = printed(docs, mark)
    found = own.join(stay, own["doc_id"].eqNullSafe(stay["_rep"]) & (own[mark] == stay["_own"]), "left_semi")
    return found.dropDuplicates(["doc_id", mark]).drop(mark)
