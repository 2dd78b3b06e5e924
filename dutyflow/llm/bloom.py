"""A Bloom filter over 64-bit hashes, built by Spark, for passes over the corpus
that look for a set of terms too large to send along as a whole.

It has BITS_EACH bits for each value, at most MOST bits (64 MB): the bound of
what is broadcast. With more values it lets more others pass, and a join with
the values themselves decides; no value is ever missed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K
from .common import arrow

BITS_EACH, LEAST, MOST = 16, 1 << 16, 1 << 29
PROBES = 3
CHUNK = 1 << 16


def bits_for(values: int) -> int:
    return min(MOST, max(LEAST, 1 << max(1, values * BITS_EACH - 1).bit_length()))


def probes(values: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    h = values.view(K.U)
    for i in range(PROBES):
        h = K.mixed(h + K.U(0x9E3779B97F4A7C15 * (i + 1) % (1 << 64)))
        yield (h & K.U(bits - 1)).astype(np.int64)


class Bloom:
    def __init__(self, data: np.ndarray):
        self.data, self.bits = data, len(data) * 8

    def holds(self, values: np.ndarray) -> np.ndarray:
        """False for values that are surely not in the set."""
        out = np.ones(len(values), bool)
        for at in probes(values, self.bits):
            out &= (self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return out


def _marked(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    data = np.zeros(bits // 8, np.uint8)
    for batch in batches:
        for at in probes(batch.column(0).to_numpy(), bits):
            np.bitwise_or.at(data, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
    chunks = data.reshape(-1, CHUNK // 8)
    for lo in range(0, len(chunks), 64):
        some = lo + np.flatnonzero(chunks[lo : lo + 64].any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([chunks[i].tobytes() for i in some], pa.binary())], ["chunk", "data"])


def _united(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CHUNK // 8, np.uint8)
    for batch in rows:
        for x in batch.column("data"):
            total |= np.frombuffer(x.as_buffer(), np.uint8)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["chunk", "data"])


def build(values: DataFrame, column: str) -> Bloom | None:
    """The filter of a long column; None if it is empty. Each task marks its own
    values, tasks are united chunk by chunk, and at most 64 MB reach the driver."""
    n = values.count()
    if not n:
        return None
    bits = bits_for(n)
    parts = arrow(values.select(column), lambda batches: _marked(batches, bits), "chunk int, data binary")
    data = np.zeros((bits // CHUNK, CHUNK // 8), np.uint8)
    for row in parts.groupBy("chunk").applyInArrow(_united, "chunk int, data binary").toLocalIterator():
        data[row["chunk"]] = np.frombuffer(row["data"], np.uint8)
    return Bloom(data.reshape(-1))
