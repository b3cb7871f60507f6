"""Exact deduplication as a stateful stream.

The table is read as a stream of files. Keyed state, one entry per digest of the
normalised text, is kept on disk (RocksDB, checkpointed to the shared folder) and never
expires: it retains the smallest identifier seen, the locator of that row's content (file
and row number) and the number of rows. Copies are combined in the map tasks first, so a
text that a third of all rows share reaches its state as one row per task. The stream can
be stopped and continued; state and progress lie in its folder.

Digests are then checked on hits: rows whose digest was seen more than once are compared
by their whole normalised text, and texts that differ under one digest part again.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fettle.llm.rows import named
from fettle.operators.spread import settle, shared_folder

STATE = "spark.sql.streaming.stateStore."
#: on disk, and without space set aside ahead: there is one store per shuffle partition
ON_DISK = {f"{STATE}providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
           f"{STATE}rocksdb.allowFAllocate": "false"}
SALTS = 16


def normalised(text: Column) -> Column:
    """Runs of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


@contextmanager
def disk_state(spark: SparkSession):
    """State on disk while the stream runs."""
    before = {name: spark.conf.get(name, None) for name in ON_DISK}
    for name, value in ON_DISK.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _glob(path: str) -> str:
    """A pattern that matches exactly ``path``; as a plain path, a stream would insist on a folder."""
    head, slash, leaf = path.rstrip("/").rpartition("/")
    return f"{head}{slash}[{leaf[0]}]{leaf[1:]}"


def _columns(source: DataFrame, key: str, text: str, digest) -> DataFrame:
    place = source.metadataColumn("_metadata")  # also where the table has a column of that name
    return source.select(digest(normalised(named(text))).alias("digest"), named(key).alias("key"),
                         place["file_path"].alias("file"), place["row_index"].alias("at"))


def first_seen(spark: SparkSession, path: str, key: str, text: str, folder: str, digest=sha256) -> DataFrame:
    """Run the stream over what lies at ``path`` and return its state: digest, n, first (none, key, file, at)."""
    schema = spark.read.parquet(path).schema
    stream = _columns(spark.readStream.schema(schema).parquet(_glob(path)), key, text, digest)
    rank = F.struct(F.col("key").isNull().alias("none"), "key", "file", "at")
    state = stream.groupBy("digest").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/state/batch={number}")

    with disk_state(spark):
        query = (state.writeStream.outputMode("update").foreachBatch(keep)
                 .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start())
        query.awaitTermination()
    # without any file the stream has no batch
    spark.createDataFrame([], state.schema).write.mode("overwrite").parquet(f"{folder}/state/batch=-1")
    updates = spark.read.schema(state.schema).parquet(f"{folder}/state")
    # an entry only ever grows: its last state has the largest count and the smallest row
    return updates.groupBy("digest").agg(F.max("n").alias("n"), F.min("first").alias("first"))


def deduplicate(spark: SparkSession, path: str, key: str = "doc_id", text: str = "text", digest=sha256,
                folder: str | None = None) -> DataFrame:
    """One row per row of the table: key, keep_id, group_size, kept, digest.

    Equal are texts whose normalised forms are the same bytes. ``keep_id`` is the smallest
    key of the group (null only if all are), ``kept`` is true for one row of each group:
    the one with that key that lies first in the files. Null texts are empty texts; null
    keys sort last; an empty table gives an empty result; other columns are not read.
    ``digest`` may be any function of the text: a weak one costs time, not correctness.
    """
    folder = folder or f"{shared_folder(spark)}/dedup-{uuid.uuid4().hex}"
    seen = settle(first_seen(spark, path, key, text, folder, digest).filter("n > 1"))
    table = spark.read.parquet(path)
    rows = settle(_columns(table, key, text, digest))
    # whole texts of the hits only; salted, as one digest may hold a large share of all rows
    salt = F.pmod(F.xxhash64("key", "at"), F.lit(SALTS)).cast("int")
    asked = seen.select("digest", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    body, place = normalised(named(text)), table.metadataColumn("_metadata")
    whole = table.select(digest(body).alias("digest"), body.alias("body"), named(key).alias("key"),
                         place["file_path"].alias("file"), place["row_index"].alias("at"))
    # by shuffle at every size: the list of hits grows with the table
    hits = whole.withColumn("salt", salt).join(asked.hint("merge"), ["digest", "salt"], "left_semi")
    rank = F.struct(F.col("key").isNull().alias("none"), "key", "file", "at")
    texts = settle(hits.groupBy("digest", "body").agg(F.count(F.lit(1)).alias("size"), F.min(rank).alias("first")))
    kinds = texts.groupBy("digest").agg(F.count(F.lit(1)).alias("kinds"))
    # one text per digest, but for collisions: those rows meet their group by the text itself
    clear = settle(texts.join(kinds.filter("kinds = 1"), "digest", "left_semi").select("digest", "size", "first"))
    mixed = settle(texts.join(kinds.filter("kinds > 1"), "digest", "left_semi"))
    parted = (whole.join(mixed, ["digest", "body"]).select("digest", "key", "file", "at", "size", "first"))
    plain = rows.join(mixed.select("digest").distinct(), "digest", "left_anti").join(clear, "digest", "left")
    every = plain.select("digest", "key", "file", "at", "size", "first").unionByName(parted)
    own = F.col("first").isNull() | ((F.col("file") == F.col("first.file")) & (F.col("at") == F.col("first.at")))
    return every.select(
        F.col("key").alias(key), F.coalesce("first.key", "key").alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), own.alias("kept"), "digest")


def report(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The digest columns of the contract."""
    return found.select(key, "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))
