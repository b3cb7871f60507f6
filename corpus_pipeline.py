"""The corpus pipeline: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fettle.llm import contamination, mixing, sharding, simhash, toxicity
from fettle.operators.spread import shared_folder


#: what Spark hands to a Python worker at a time; texts may be long, so bytes bound it rather than rows
BATCH_BYTES = 8 << 20


def bounded(spark: SparkSession) -> None:
    """Hand texts to Python workers in small batches."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model does not reject; it is fitted on the labelled ones among ``docs``."""
    bounded(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    # the caller's columns travel in one struct, so none clashes with the model's
    rest = F.struct(*[c for c in docs.columns if c != "text"]).alias("rest")
    kept = toxicity.score(docs.select(rest, "text"), model).filter(~F.col("toxic"))
    return kept.select(*["text" if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    bounded(spark)
    return simhash.deduplicate(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of the benchmark; ``n_chars`` follows the text."""
    bounded(spark)
    cut = contamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return cut.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else cut


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources meet their target weights."""
    return mixing.mix(docs).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and slot."""
    bounded(spark)
    return sharding.two_pass_shuffle(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", cut_benchmark),
    ("source_mixing", mix_sources),
    ("sharding", shard),
]

#: The stages hash words, search indexes and shuffle by seeded generators; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}-{name}")
        docs = spark.read.parquet(f"{folder}/{number}-{name}")
    return docs
