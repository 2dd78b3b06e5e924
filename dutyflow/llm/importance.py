"""Importance resampling towards a target text set, with overlapping chunks.

Documents are drawn in the order of their log-likelihood gain (hashed runs of
words of the target against those of all documents) plus Gumbel noise that the
doc_id alone decides. Texts longer than CHUNK bytes are cut at word boundaries
into chunks that carry the next n-1 words along; a chunk owns the runs that start
before its carry, so every run of the text is counted exactly once wherever it is
cut. Chunks of one text are dealt to tasks on their own, and their counts and
weights are summed by document. Only histograms of BUCKETS numbers reach the
driver; the draw is a distributed sort of (score, doc_id) rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow, numbered, stored, unused

RUN = 1
BUCKETS = 10_000
SCALE = 1000
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
CHUNK = 1 << 18
_CACHE = 1 << 19
#: A-Z to a-z, all other ASCII but digits and letters to a blank; bytes over 127 stay.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xFF]+")


def cut(data: bytes, n: int = RUN, size: int = CHUNK) -> Iterator[tuple[bytes, int]]:
    """(chunk, carried words) of a text: chunks of about ``size`` bytes that end at
    a word boundary, each with the next n-1 words of the text behind it."""
    at = 0
    while at < len(data):
        gap = _GAP.search(data, at + size) if at + size < len(data) else None
        end = stop = gap.end() if gap else len(data)
        carried = 0
        for word in _WORD.finditer(data, end):
            if carried == n - 1:
                break
            stop, carried = word.end(), carried + 1
        yield data[at:stop], carried
        at = end


class Buckets(dict):
    """The bucket of each feature, kept as long as there are not too many."""

    def __missing__(self, feature: bytes) -> int:
        if len(self) > _CACHE:
            self.clear()
        self[feature] = found = zlib.crc32(feature) % BUCKETS
        return found


def features(data: bytes, carried: int, n: int, buckets: Buckets) -> tuple[int, np.ndarray]:
    """Words that a chunk owns, and the buckets of all runs of 1 to n words that start with them."""
    words = data.translate(_PLAIN).split()
    own = len(words) - carried
    found = words[:own]
    for k in range(2, n + 1):
        found = found + [b" ".join(words[i : i + k]) for i in range(min(own, len(words) - k + 1))]
    return own, np.fromiter(map(buckets.__getitem__, found), np.int32, len(found))


def chunks(docs: DataFrame, n: int = RUN, size: int = CHUNK) -> DataFrame:
    """doc_id, mark (hash of the text), chunk (from 0; null: the whole text),
    data (bytes) and carried. Texts of up to ``size`` bytes stay where they are;
    the chunks of longer ones are dealt out by hash."""
    id_type = dict(docs.dtypes)["doc_id"]
    own = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("data"))
    short = own.where(F.octet_length("data") <= size).select("doc_id", "mark", F.lit(None).cast("int").alias("chunk"), "data", F.lit(0).alias("carried"))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "mark", "chunk", "data", "carried"]
        for batch in batches:
            for i in range(batch.num_rows):
                for k, (data, carried) in enumerate(cut(batch.column("data")[i].as_py(), n, size)):
                    row = [batch.column("doc_id").slice(i, 1), batch.column("mark").slice(i, 1)]
                    yield pa.RecordBatch.from_arrays([*row, pa.array([k], pa.int32()), pa.array([data], pa.binary()), pa.array([carried], pa.int32())], names)

    long = arrow(own.where(F.octet_length("data") > size), mapped, f"doc_id {id_type}, mark long, chunk int, data binary, carried int")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return short.unionByName(long.repartition(parts, "doc_id", "mark", "chunk"))


def histogram(parts: DataFrame, n: int = RUN) -> np.ndarray:
    """How many features of all chunks fall into each bucket: one row for each
    task and bucket, BUCKETS rows to the driver."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, buckets = np.zeros(BUCKETS, np.int64), Buckets()
        for batch in batches:
            for data, carried in zip(batch.column("data"), batch.column("carried"), strict=True):
                total += np.bincount(features(data.as_py(), carried.as_py(), n, buckets)[1], minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for row in arrow(parts.select("data", "carried"), mapped, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds to a weight: the smoothed log ratio, in thousandths, rounded down."""
    all_source, all_target = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    ratio = [(float(t) + 1) * all_source / ((float(s) + 1) * all_target) for s, t in zip(source, target, strict=True)]
    return np.array([math.floor(SCALE * math.log(x)) for x in ratio], np.int64)


def weights(parts: DataFrame, gain: np.ndarray, n: int = RUN) -> DataFrame:
    """doc_id, mark, n_words, n_features and weight of every document, summed over its chunks."""
    id_type = dict(parts.dtypes)["doc_id"]

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for batch in batches:
            rows = []
            for data, carried in zip(batch.column("data"), batch.column("carried"), strict=True):
                own, found = features(data.as_py(), carried.as_py(), n, buckets)
                rows.append((own, len(found), int(gain[found].sum())))
            sums = np.array(rows, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "mark", "chunk")), *(pa.array(sums[:, i]) for i in range(3))], ["doc_id", "mark", "chunk", "n_words", "n_features", "weight"])

    told = stored(arrow(parts, mapped, f"doc_id {id_type}, mark long, chunk int, n_words long, n_features long, weight long"), "gain-chunks")
    names = ["n_words", "n_features", "weight"]
    # rows equal in id and text are one group: its sums are of all its copies
    long = told.where("chunk is not null").groupBy("doc_id", "mark").agg(F.count_if(F.col("chunk") == 0).alias("copies"), *[F.sum(c).alias(c) for c in names])
    each = long.select("doc_id", "mark", *[F.expr(f"{c} div copies").alias(c) for c in names], F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")
    return told.where("chunk is null").drop("chunk").unionByName(each)


def noise(doc_id: Column) -> Column:
    """Gumbel noise in thousandths from the SHA-256 of seed and id; a null id counts as empty text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-float(SCALE)) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def _ranked(docs: DataFrame, target: DataFrame, n: int, percent: int) -> DataFrame:
    item = target.select(F.lit(0).alias("doc_id"), "text")
    parts = chunks(docs, n)
    gain = gains(histogram(parts, n), histogram(chunks(item, n), n))
    scored = weights(parts, gain, n).withColumn("score", F.col("weight") + noise(F.col("doc_id")))
    enough = F.col("n_words") >= LEAST_WORDS
    # rows equal in both differ by mark at most, so a third equal ones may not be dealt apart: the last order is a place in the table
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("mark"), F.col("_at")]
    placed, total = numbered(scored.where(enough).withColumn("_at", F.monotonically_increasing_id()), order, "gain-order")
    drawn = percent * total // 100
    ranked = placed.withColumn("rank", F.when(F.col("row") < drawn, F.col("row") + 1)).drop("row", "_at")
    return ranked.unionByName(scored.where(~enough).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, n: int = RUN, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document (all long but
    the id); of those with LEAST_WORDS words, ``percent`` of a hundred with the
    highest scores are drawn and ranked from 1, ties by the smaller doc_id (nulls
    last), others have a null rank.

    Features are runs of 1 to ``n`` words (a-z, digits and all beyond ASCII, A-Z
    lower-cased); a null text has none and weight 0. Rows equal in id and text
    get equal weights and ranks of their own; a null id counts as empty in the
    noise. Long texts are summed over chunks; empty tables, of documents or
    target, give no rows or count as zero; other columns are ignored."""
    return _ranked(docs, target, n, percent).select("doc_id", "n_features", "weight", "score", "rank")


def drawn(docs: DataFrame, target: DataFrame, n: int = RUN, percent: int = PERCENT) -> DataFrame:
    """The drawn documents themselves with all their columns. Rows equal in id and
    text are one choice and all stay if one is drawn; edge cases are as in resample()."""
    chosen = _ranked(docs, target, n, percent).where("rank is not null").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_m")).distinct()
    mark = unused(docs, "_mark")
    own = docs.withColumn(mark, F.xxhash64("text"))
    return own.join(chosen, own["doc_id"].eqNullSafe(chosen["_id"]) & (own[mark] == chosen["_m"]), "left_semi").drop(mark)
