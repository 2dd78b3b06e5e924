"""A training-corpus pipeline: each stage applies one operator to all that the
stage before it kept, written as Parquet and read again in between."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dutyflow.llm import common, decontam, langid, mixing, neardup, sharding

SHARDS = 40


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or in no recognised language go."""
    return langid.known(docs, langid.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest id stays."""
    return neardup.kept(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, also re-parameterised ones, go."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; left-out ones go."""
    return mixing.mixed(docs)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with all its columns, its size, checksum, shard and slot. A
    column of the documents that is called like one of these four gets doc_ in front."""
    own, results = common.unused(docs, "_doc"), ("size", "text_crc32", "shard", "slot")
    dealt = sharding.shard(docs.withColumn(own, F.struct(*[F.col(f"`{c}`") for c in docs.columns])), SHARDS, keep=(own,))
    kept = [F.col(own)[c].alias(f"doc_{c}" if c.lower() in results else c) for c in docs.columns]
    return dealt.select(*kept, *results)


STAGES = [
    ("language ID", identify_language),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mix sources", mix_sources),
    ("shard", deal_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; a stage's output goes through the shared folder.

    The documents need doc_id, text, lang and source; other columns come along. Null
    ids, texts, languages and sources, repeated rows, empty texts and very long ones
    are treated as the stages' operators say; an empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.stored(docs, f"stage-{i}")
    return docs


#: Signatures and permutations cannot be expressed in SQL; tests hold run() against brute force.
ORACLE_SQL = None
