"""Incremental ingest: a file stream whose batches overwrite the months that they bring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

SHIFTS = "workplace_id string, date date, ym string, type string, start string, end string, src_seq long"


def ingest_stream(spark: SparkSession, landing: str, target: str, checkpoint: str, schema: str = SHIFTS) -> None:
    """Takes all new files of ``landing`` and stops. A batch replaces the
    (workplace, month) partitions that it has rows for, by dynamic partition
    overwrite, so a batch that is run again after a failure changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        from ..operators.merge import dedupe

        rows = dedupe(batch.withColumn("_part", F.lit(0)))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("workplace_id", "ym").parquet(target)

    query = spark.readStream.schema(schema).parquet(landing).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def as_shifts(events: DataFrame) -> DataFrame:
    """Events as shifts of four workplaces."""
    return events.select(
        F.concat(F.lit("u"), F.col("user_id") % 4).alias("workplace_id"), F.to_date("ts").alias("date"), F.date_format("ts", "yyyy-MM").alias("ym"),
        F.col("event_type").alias("type"), F.date_format("ts", "HH:mm").alias("start"), F.lit("").alias("end"), F.col("event_id").alias("src_seq"),
    )


def streamed(rows: DataFrame) -> DataFrame:
    """The stored rows after a streamed ingest of shifts, run twice: the second run finds nothing new."""
    spark = rows.sparkSession
    base = shared_folder(spark, "stream")
    rows.write.parquet(f"{base}/landing")
    for _ in range(2):
        ingest_stream(spark, f"{base}/landing", f"{base}/target", f"{base}/state")
    return spark.read.parquet(f"{base}/target").select(*[F.col(c).cast(t) for c, t in rows.dtypes])


def equals_batch(spark: SparkSession, events: DataFrame) -> DataFrame:
    """One row: how many rows differ between a streamed and a plain ingest of the events, and whether none does."""
    from ..operators.merge import dedupe

    rows = as_shifts(events)
    batch, stream = dedupe(rows.withColumn("_part", F.lit(0))).select(*rows.columns), streamed(rows)
    off = batch.exceptAll(stream).unionAll(stream.exceptAll(batch)).agg(F.count("*").alias("differing"))
    return off.select(F.lit("stream_upsert").alias("check"), "differing", (F.col("differing") == 0).alias("equal"))
