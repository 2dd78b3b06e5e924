"""Waiting for answers with a timeout, as a keyed stream with timers.

Each key asks once or more; an answer in time ends the wait, else a timer does.
Keys are dealt over SHARES groups, so that a batch and its state reach Python by
the group, not key by key. The state of a group is the keys that wait and since
when, and its one timer is that of the wait that ends first; the watermark
removes those that are over, so state does not grow with the stream."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import shared_folder, ship

INPUT = "key string, at timestamp, kind string"
RESULT = "key string, asked timestamp, outcome string, waited_s double"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Groups of keys; a stream that goes on from a checkpoint must keep their number.
SHARES = 1024


class Waiting(StatefulProcessor):
    """'ask' opens a wait, 'answer' ends it; what comes too late or unasked is 'late'.

    Rows of a key are taken in the order of time within a batch. An ask while
    another waits changes nothing, but one whose wait is over opens a new one."""

    def __init__(self, timeout_s: float):
        self.timeout_ms = int(timeout_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waits = handle.getListState("waits", "key string, at long")

    def _open(self) -> dict[str | None, int]:
        return dict(self.waits.get()) if self.waits.exists() else {}

    def _ends(self, asked: int) -> int:
        return asked // 1000 + self.timeout_ms + 1

    def _keep(self, waiting: dict[str | None, int]) -> None:
        """Stores the waits of a group and sets its timer."""
        if waiting:
            self.waits.put(list(waiting.items()))
        else:
            self.waits.clear()
        due = self._ends(min(waiting.values())) if waiting else None
        timers = [t if isinstance(t, int) else t[0] for t in self.handle.listTimers()]
        for timer in timers:
            if timer != due:
                self.handle.deleteTimer(timer)
        if due is not None and due not in timers:
            self.handle.registerTimer(due)

    @staticmethod
    def _rows(out: Iterable[tuple]) -> pd.DataFrame:
        key, asked, outcome, waited = zip(*out, strict=True)
        return pd.DataFrame({"key": pd.Series(key, dtype=object), "asked": pd.Series(pd.array(asked, dtype="Int64")).astype("datetime64[us]"), "outcome": outcome, "waited_s": pd.Series(waited, dtype=float)})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - names of the interface
        every = pd.concat(list(rows)).sort_values(["at", "kind"], kind="stable")
        waiting, out = self._open(), []
        for who, now, kind in zip(every["key"], every["at"].astype("datetime64[us]").astype("int64").tolist(), every["kind"], strict=True):
            asked = waiting.get(who)
            if asked is not None and now - asked > self.timeout_ms * 1000:
                out.append((who, asked, "timeout", None))
                del waiting[who]
                asked = None
            if kind == "answer":
                if asked is None:
                    out.append((who, None, "late", None))
                else:
                    out.append((who, asked, "answered", (now - asked) / 1e6))
                    del waiting[who]
            elif kind == "ask" and asked is None:
                waiting[who] = now
        self._keep(waiting)
        if out:
            yield self._rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        waiting = self._open()
        over = [(who, asked, "timeout", None) for who, asked in waiting.items() if self._ends(asked) <= passed]
        for who, *_ in over:
            del waiting[who]
        self._keep(waiting)
        if over:
            yield self._rows(over)

    def close(self) -> None:
        pass


def outcomes(stream: DataFrame, timeout_s: float, delay: str = "0 seconds") -> DataFrame:
    """(key, asked, outcome, waited_s) of a stream (key, at, kind). Its session
    needs the RocksDB state store (STORE = ROCKS)."""
    ship(stream.sparkSession)
    dealt = stream.withWatermark("at", delay).withColumn("share", F.pmod(F.xxhash64("key"), F.lit(SHARES)))
    return dealt.groupBy("share").transformWithStateInPandas(Waiting(timeout_s), RESULT, "append", "eventTime")


def replayed(rows: DataFrame, timeout_s: float) -> DataFrame:
    """The outcomes of stored rows (key, at, kind) sent through the stream in two
    batches, the second with one later row that lets the last timers expire."""
    spark: SparkSession = rows.sparkSession
    base = shared_folder(spark, "waits")
    rows.select("key", "at", "kind").write.parquet(f"{base}/landing/a")
    last = spark.read.schema(INPUT).parquet(f"{base}/landing/a").agg(F.lit("").alias("key"), (F.max("at") + F.expr(f"INTERVAL {int(2 * timeout_s) + 60} SECONDS")).alias("at"), F.lit("tick").alias("kind"))
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        def run() -> None:
            stream = spark.readStream.schema(INPUT).option("recursiveFileLookup", "true").parquet(f"{base}/landing")
            query = outcomes(stream, timeout_s).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
            query.awaitTermination()

        run()
        last.where("at IS NOT NULL").coalesce(1).write.parquet(f"{base}/landing/b")
        run()
    finally:
        spark.conf.set(STORE, before)
    return spark.read.schema(RESULT).parquet(f"{base}/out").where("key <> ''")
