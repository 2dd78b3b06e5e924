"""Tables as the store: partitioned by workplace and month, encrypted payloads, deletes."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

PREFIX = "enc1:"


class Locked(RuntimeError):
    """The payload could not be decrypted; writing over it would lose data."""


def encrypt(text: Column, key: Column) -> Column:
    return F.concat(F.lit(PREFIX), F.base64(F.aes_encrypt(text, key)))


def decrypt(payload: Column, key: Column) -> Column:
    """Plain payloads pass; one that cannot be decrypted gives null."""
    body = F.unbase64(F.regexp_replace(payload, f"^{PREFIX}", ""))
    return F.when(F.startswith(payload, F.lit(PREFIX)), F.try_aes_decrypt(body, key).cast("string")).otherwise(payload)


def decoded(payload: Column, schema: str, fallback: Column) -> Column:
    """A JSON payload by a fixed schema; what cannot be read gives the fallback."""
    return F.coalesce(F.from_json(payload, schema, {"mode": "PERMISSIVE"}), fallback)


def require_unlocked(payloads: DataFrame, key: Column) -> None:
    bad = payloads.where(F.col("payload").isNotNull() & decrypt(F.col("payload"), key).isNull())
    if bad.limit(1).count():
        raise Locked("the store cannot be decrypted; nothing is written")


def save(rows: DataFrame, path: str, tenant: str) -> None:
    """Writes shifts; untagged rows get the tenant. Only partitions with rows are replaced."""
    tagged = rows.withColumn("workplace_id", F.coalesce("workplace_id", F.lit(tenant))).withColumn("ym", F.date_format("date", "yyyy-MM"))
    tagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("workplace_id", "ym").parquet(path)


def load(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The stored rows; an absent store is empty."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def _opened(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, and the path for it."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def remove(spark: SparkSession, path: str) -> bool:
    """Removes a folder with all that it holds; says if it was there."""
    files, folder = _opened(spark, path)
    return bool(files.delete(folder, True))


def drop_tenant(spark: SparkSession, path: str, tenant: str) -> bool:
    """Removes a workplace's partition folder."""
    return remove(spark, f"{path}/workplace_id={tenant}")


def local_folder(spark: SparkSession, path: str) -> str | None:
    """The path as the operating system names it; null if it is not in its files (file:)."""
    files, folder = _opened(spark, path)
    uri = files.makeQualified(folder).toUri()
    return str(uri.getPath()) if uri.getScheme() == "file" else None


def succeeded(spark: SparkSession, path: str) -> None:
    """Marks a folder as complete, as Spark's writers do."""
    files, folder = _opened(spark, f"{path}/_SUCCESS")
    files.create(folder, True).close()


#: How Spark names the folder of a null, and what it escapes in names of folders.
NULL, _ESCAPED = "__HIVE_DEFAULT_PARTITION__", re.compile(r"""[\x00-\x1f"#%'*/:=?\\\x7f{\[\]^]""")


def keyed_writer(folder: str, name: str, line_end: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over (key, line) sorted by key: writes the lines of each key to folder/key=value/name and gives the number of files.

    A file takes its name when it is complete, and a repeated task writes the same files."""

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written, now, out = 0, None, None  # now: the key, its folder, the name until the file is complete

        def close() -> None:
            out.close()
            os.replace(now[2], f"{now[1]}/{name}")

        for part in parts:
            for key, line in zip(part[0].to_pylist(), part[1].to_pylist(), strict=True):
                if now is None or now[0] != key:
                    if now:
                        close()
                    value = NULL if key is None else _ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", key)
                    own = f"{folder}/{part.schema.names[0]}={value}"
                    os.makedirs(own, exist_ok=True)
                    now, written = (key, own, f"{own}/.{uuid.uuid4().hex}"), written + 1
                    out = open(now[2], "w", encoding="utf-8", newline="")  # noqa: SIM115 - stays open over batches
                out.write((line or "") + line_end)
        if now:
            close()
        yield pa.RecordBatch.from_pydict({"files": [written]})

    return write


def merged(*layers: Column) -> Column:
    """Right-most layer that has a value."""
    return F.coalesce(*reversed(layers))
