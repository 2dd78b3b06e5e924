"""Quality rules with cross-document line frequency.

One pass over the texts gives each document's counts and the hashes of its
distinct normalised lines (ASCII lower case, white space runs as one blank).
Lines are counted by host, a document once for each; a line in more than
max(LEAST_DOCUMENTS, SHARE of the host's documents) is boilerplate. A document
whose words mostly stand in boilerplate lines is depleted and rejected."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import arrow, salted, same_keys, stored

LEAST_DOCUMENTS, SHARE = 20, 0.02
#: A document is depleted below so many left words, or below this share of its words.
LEFT_WORDS, LEFT_SHARE = 10, 0.3
REPEAT_WINDOW = 5
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _per_document(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def _repeats(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value: does an equal one exist, and is it the first (in order) of its kind."""
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    change = np.r_[True, ranked[1:] != ranked[:-1]] if len(key) else np.zeros(0, bool)
    runs = np.diff(np.r_[np.flatnonzero(change), len(key)])
    many, first = np.zeros(len(key), bool), np.zeros(len(key), bool)
    many[order] = np.repeat(runs > 1, runs)
    first[order] = change
    return many, first


def facts(data: np.ndarray, offs: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Counts by document, and of its distinct normalised lines: bounds by document, hashes, words."""
    n = len(offs) - 1
    start, end, bounds = K.words(data, offs)
    low = _LOWER[data]
    word = K.span_hash(K.sums(low), start, end)
    exact = K.sums(data)
    out = {"n_words": np.diff(bounds), "word_chars": _per_document(~K.SPACES[data] & ((data & 0xC0) != 0x80), offs), "n_symbols": _per_document(SYMBOLS[data], offs)}
    # words in repeated windows
    run, at = K.windows(K.span_hash(exact, start, end), bounds, REPEAT_WINDOW)
    doc = np.searchsorted(bounds, at, "right") - 1
    many, _ = _repeats(K.mixed(run + K.mixed(doc.astype(K.U))))
    cover = np.zeros(len(start) + 1, np.int64)
    np.add.at(cover, at[many], 1)
    np.add.at(cover, np.minimum(at[many] + REPEAT_WINDOW, bounds[doc[many] + 1]), -1)
    out["n_repeat_words"] = _per_document(np.cumsum(cover[:-1]) > 0, bounds)
    # lines: between document bounds and line feeds
    feeds = np.flatnonzero(data == 10)
    owner = np.r_[np.arange(n), np.searchsorted(offs, feeds, "right") - 1]
    order = np.argsort(owner, kind="stable")
    owner = owner[order]
    line_start = np.r_[offs[:-1], feeds + 1][order]
    same = np.zeros(len(owner), bool)
    same[:-1] = owner[1:] == owner[:-1]
    line_end = np.where(same, np.r_[line_start[1:], 0] - 1, offs[owner + 1])
    first, last = np.searchsorted(start, line_start), np.searchsorted(start, line_end)
    full = last > first
    owner, first, last, line_start, line_end = owner[full], first[full], last[full], line_start[full], line_end[full]
    mark = K.mixed(owner.astype(K.U))
    _, new = _repeats(K.mixed(K.span_hash(exact, line_start, line_end) + mark))
    out["n_dup_lines"] = np.bincount(owner[~new], minlength=n).astype(np.int64)
    total = np.zeros(len(word) + 1, dtype=K.U)
    np.cumsum(word * K.powers(len(word)), out=total[1:])
    line = K.span_hash(total, first, last)
    key = K.mixed(line + mark)
    _, one = _repeats(key)
    kinds, where = np.unique(key, return_inverse=True)
    words = np.bincount(where, last - first, len(kinds)).astype(np.int64)[where]
    return out, np.searchsorted(owner[one], np.arange(n + 1)), line[one].view(np.int64), words[one]


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [c for c in batch.schema.names if c != "text"]
        data, offs = K.buffers(batch.column("text"))
        for lo, hi, piece, at in K.pieces(data, offs):
            counts, bounds, lines, words = facts(piece, at)
            own = [batch.column(c).slice(lo, hi - lo) for c in keys]
            ends = pa.array(bounds.astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (lines, words)]
            yield pa.RecordBatch.from_arrays([*own, *[pa.array(counts[c].astype(np.int64)) for c in COUNTS], *lists], [*keys, *COUNTS, "lines", "line_words"])


def _measured(docs: DataFrame, host: str, *more: Column) -> tuple[DataFrame, DataFrame]:
    """Counts of every row (doc_id, host, _row, more), and its lines over the host's limit (_row, line, words)."""
    source = docs.select("doc_id", F.col(host).alias("host"), F.monotonically_increasing_id().alias("_row"), *more, "text")
    keys = [f"{c} {t}" for c, t in source.dtypes if c != "text"]
    schema = ", ".join([*keys, *[f"{c} long" for c in COUNTS], "lines array<long>", "line_words array<long>"])
    seen = stored(arrow(source, _scanned, schema), "quality")
    limits = seen.groupBy("host").agg(F.greatest(F.lit(float(LEAST_DOCUMENTS)), F.count("*") * F.lit(SHARE)).alias("limit"))
    each = seen.select("_row", "host", F.explode(F.arrays_zip("lines", "line_words")).alias("l")).select("_row", "host", F.col("l.lines").alias("line"), F.col("l.line_words").alias("words"))
    often = each.groupBy("host", "line").agg(F.count("*").alias("documents")).where(F.col("documents") > LEAST_DOCUMENTS)
    often = same_keys(often, limits, ["host"]).where(F.col("documents") > F.col("limit")).select("host", "line")
    return seen.drop("lines", "line_words"), salted(each, often, ["host", "line"], F.col("_row"))


def _judged(seen: DataFrame, gone: DataFrame) -> DataFrame:
    """Adds base_failed, n_boilerplate_words and kept; gone: _row, gone (words)."""
    out = seen.join(gone, "_row", "left").withColumn("n_boilerplate_words", F.coalesce("gone", F.lit(0)))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    left = F.col("n_words") - F.col("n_boilerplate_words")
    depleted = (F.col("n_boilerplate_words") > 0) & ((left < LEFT_WORDS) | (left < F.col("n_words") * F.lit(LEFT_SHARE)))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)


def rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, the five counts, base_failed, n_boilerplate_words and kept of every row.

    A null or empty text has no words, so it fails; a null host is a host of
    its own; each row is a document, also if rows repeat; a very long text is
    measured to its end; an empty table gives no rows; other columns are ignored."""
    seen, hits = _measured(docs, host)
    out = _judged(seen, hits.groupBy("_row").agg(F.sum("words").alias("gone")))
    return out.select("doc_id", *COUNTS, "base_failed", "n_boilerplate_words", "kept")


def without_lines(texts: pa.Array, gone: list[list[int] | None]) -> pa.Array:
    """The texts without those of their lines whose normalised hashes are in ``gone``."""
    rows = np.array([i for i, g in enumerate(gone) if g], np.int64)
    lines = pc.split_pattern(texts.take(pa.array(rows)), "\n")
    flat, bounds = lines.flatten(), np.r_[0, np.cumsum(lines.value_lengths().to_numpy(zero_copy_only=False))]
    key, full = np.zeros(len(flat), np.int64), np.zeros(len(flat), bool)
    data, offs = K.buffers(flat)
    for lo, hi, piece, at in K.pieces(data, offs):
        _, first, hashes, _ = facts(piece, at)
        own = np.flatnonzero(np.diff(first))
        key[lo + own], full[lo + own] = hashes[first[own]], True
    out = texts.to_pylist()
    for i, a, b in zip(rows, bounds[:-1], bounds[1:], strict=True):
        stay = ~(full[a:b] & np.isin(key[a:b], gone[i]))
        out[i] = "\n".join(flat.slice(a, b - a).filter(pa.array(stay)).to_pylist())
    return pa.array(out, texts.type)


def cleaned(docs: DataFrame, host: str = "source") -> DataFrame:
    """The documents that rules() keeps, with all their columns, in whose texts
    the lines over their host's limit are removed; all other lines stay as they are.

    Verdicts are looked up by host and text, so rows that are equal in both fare
    alike. Null and empty texts, null hosts, repeated rows and an empty table are as in rules()."""
    name = F.coalesce(F.concat(F.lit("h"), F.col(host).cast("string")), F.lit("n"))
    mark = F.unhex(F.md5(F.concat(name, F.lit("\n"), F.coalesce("text", F.lit(""))))).alias("_mark")
    seen, hits = _measured(docs, host, mark)
    gone = hits.groupBy("_row").agg(F.sum("words").alias("gone"), F.collect_list("line").alias("_lines"))
    stay = _judged(seen, gone).where("kept").groupBy("_mark").agg(F.first("_lines", ignorenulls=True).alias("_lines"))
    both = salted(docs.withColumn("_mark", mark), stay, ["_mark"], F.col("doc_id"))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = without_lines(batch.column("text"), batch.column("_lines").to_pylist())
            yield pa.RecordBatch.from_arrays([texts if c == "text" else batch.column(c) for c in names], names)

    return arrow(both, run, ", ".join(f"`{c}` {t}" for c, t in docs.dtypes))
