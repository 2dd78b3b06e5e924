"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Row i of the documents in id order goes to place p(i) of a keyed permutation
of 0..n-1. Shard and slot are p mod shards and p div shards, so they can be
computed for any row (and inverted) without a table, shards differ by one row
at most, and the same key gives the same shuffle."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, ship, unused

KEY, ROUNDS = 20240607, 6
OVERHEAD = 16


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    z = x.astype(np.uint64) + np.uint64(salt & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _halves(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def permute(rows: np.ndarray, n: int, key: int = KEY, rounds: int = ROUNDS, inverse: bool = False) -> np.ndarray:
    """The place of each row number (or, inverted, the row number of each place).

    The Feistel network works on pairs from two ranges whose product just
    covers n; a value that leaves 0..n-1 is sent through again (cycle
    walking) until it is back inside."""
    a, b = _halves(n)
    out = np.asarray(rows, dtype=np.int64).copy()
    todo = np.arange(len(out))
    order = range(rounds - 1, -1, -1) if inverse else range(rounds)
    sign = -1 if inverse else 1
    while len(todo):
        hi, lo = np.divmod(out[todo], b)
        for r in order:
            salt = key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03
            if r % 2:
                hi = (hi + sign * (_mixed(lo, salt) % np.uint64(a)).astype(np.int64)) % a
            else:
                lo = (lo + sign * (_mixed(hi, salt) % np.uint64(b)).astype(np.int64)) % b
        out[todo] = hi * b + lo
        todo = todo[out[todo] >= n]
    return out


def shard(docs: DataFrame, shards: int, key: int = KEY, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, ``keep`` columns, row, shard and slot of every row.

    Rows are numbered by doc_id (nulls first), then by size and checksum, so
    repeated rows get neighbouring numbers; rows equal in all three stand as in
    the table, and however many they are, the sort deals them out. A null text has
    0 bytes and checksum 0; a very long one is read where it stands. An empty table
    gives no rows."""
    if shards < 1:
        raise ValueError("shards must be positive")
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    facts = docs.select("doc_id", (F.octet_length(raw) + F.lit(OVERHEAD)).cast("long").alias("size"), F.crc32(raw).cast("long").alias("text_crc32"), *[F.col(c) for c in keep if c != "doc_id"])
    ship(docs.sparkSession)
    at = unused(facts, "_at")
    rows, n = numbered(facts.withColumn(at, F.monotonically_increasing_id()), [F.col("doc_id"), F.col("size"), F.col("text_crc32"), F.col(at)], "shard")
    rows = rows.drop(at)

    @F.pandas_udf("long")
    def place(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(permute(part.to_numpy(), n, key))

    out = rows.withColumn("_place", place("row"))
    return out.withColumn("shard", F.pmod("_place", F.lit(shards)).cast("int")).withColumn("slot", F.expr(f"_place div {int(shards)}")).drop("_place")
