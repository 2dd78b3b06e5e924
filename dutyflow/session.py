"""Session builder with the settings every plan here assumes."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str = "local[*]", app: str = "dutyflow", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in (SETTINGS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors
    share. Only a session on one machine that names none gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="dutyflow-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def landed(rows: DataFrame, name: str) -> DataFrame:
    """Rows written to the shared folder at once and read again: for what several steps read, each of which would compute it anew."""
    path = shared_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def tasks(spark: SparkSession) -> int:
    """Tasks that keep all cores busy, also with tasks of uneven length."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt over tasks() tasks by ``keys``. Small rows that stand for much
    work (pages to be drawn, texts to be parsed) come from one small file, and
    adaptive execution joins small partitions again; a given number stays."""
    return rows.repartition(tasks(rows.sparkSession), *keys)


_shipped: set[str] = set()
#: Rows of an Arrow batch: pages, rasters and files are large, and a worker holds a batch as Python objects.
BATCH_ROWS, _BATCH = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each application, so
    that they need neither an installation nor the driver's folder."""
    if int(spark.conf.get(_BATCH)) > BATCH_ROWS:  # plans read this when they run, so it stays lowered
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).resolve().parent
        archive = shutil.make_archive(f"{tempfile.mkdtemp()}/{package.name}-{app}", "zip", package.parent, package.name)
        spark.sparkContext.addPyFile(archive)
        _shipped.add(app)
