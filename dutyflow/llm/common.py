"""What several corpus operators share: shared-folder tables, joins that
survive hot keys, and distributed row numbers."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

SALTS = 16
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def arrow(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """mapInArrow with this package at hand, in batches of BATCH_ROWS rows at
    most: texts are long, and both sides hold a batch as a whole. Plans read this
    setting when they run, so it stays lowered for the session."""
    spark = df.sparkSession
    ship(spark)
    if int(spark.conf.get(_BATCH)) > BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a session on one machine that names none (tests) gets a temporary
    folder; on a cluster that would be a folder of the driver alone."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="dutyflow-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back.

    It cuts the lineage like a checkpoint, but evaluates the plan only once,
    keeps columns prunable and outlives lost executors. Results may read these
    tables, so they stay: one folder for each application, to be removed by whoever
    clears the checkpoint folder. It is a job that runs while the plan is made."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where null equals null; the right keys are dropped."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys])
    out = left.join(renamed, on, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"_r_{k}" for k in keys])


def salted(left: DataFrame, right: DataFrame, keys: list[str], salt: Column, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """same_keys() for a left side on which one key may hold a third of all
    rows: left rows are spread by ``salt`` and each right row is repeated
    ``salts`` times."""
    a = left.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(salts)).cast("int"))
    b = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return same_keys(a, b, [*keys, "_salt"], how).drop("_salt")


def numbered(df: DataFrame, order: list[Column], name: str, column: str = "row") -> tuple[DataFrame, int]:
    """Adds gapless row numbers from 0 in the given order, and the row count.

    Rows are range-partitioned and sorted within partitions; the number is the
    place in the partition plus the rows of earlier partitions. Only one count
    for each partition reaches the driver; the jobs run while the plan is made."""
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    table = stored(
        dealt.withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        name,
    )
    counts = {r["_part"]: r["n"] for r in table.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    total, starts = 0, []
    for part in sorted(counts):
        starts.append((part, total))
        total += counts[part]
    offsets = spark.createDataFrame(starts or [(0, 0)], "_part int, _start long")
    out = table.join(F.broadcast(offsets), "_part")  # one row for each partition
    return out.withColumn(column, F.col("_start") + F.col("_place")).drop("_part", "_start", "_place"), total
