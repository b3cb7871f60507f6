"""Global shuffle into equal shards, by two passes over external storage.

Pass one scatters rows into buckets of about ``bucket_bytes`` by a seeded hash of their
key. Pass two loads one bucket at a time, brings it into an order that does not depend on
how it arrived, shuffles it (Fisher-Yates, seeded by the bucket) and writes it. Counts of
the written buckets give each row its place in the whole, and the places are dealt round
the shards: shard = place mod shards, slot = place div shards. So the law is ``rows``:
shard sizes differ by one at most and slots have no gaps.

Keys whose rows take more than a quarter of a bucket together, and null keys, are
scattered by row position instead, so no bucket grows with the copies of one document.
There are at most four such keys a bucket; their list is a table, joined as its size allows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fettle.llm.rows import layout, named, packed, unpacked
from fettle.operators.spread import settle

BUCKET_BYTES = 16 << 20
ROW_BYTES = 64  # counted for a row beside its text


def _shuffled(seed: int):
    """Fisher-Yates on one bucket, as an Arrow table in and out."""
    def shuffle(bucket):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        order = pc.sort_indices(bucket.select(["canon"]), sort_keys=[("canon", "ascending")]).to_numpy()
        number = bucket.column("bucket")[0].as_py()
        # numpy's permutation is the Fisher-Yates shuffle
        mixed = np.random.Generator(np.random.PCG64([seed, number])).permutation(order)
        shuffled = bucket.drop_columns(["canon"]).take(pa.array(mixed))
        return shuffled.append_column("place", pa.array(np.arange(len(mixed), dtype=np.int64)))

    return shuffle


def weight(body: Column) -> Column:
    return F.coalesce(F.octet_length(body), F.lit(0)) + F.lit(ROW_BYTES)


def scatter(rows: DataFrame, seed: int, buckets: int, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``row`` with ``bucket`` and ``canon``, the order within a bucket before it is shuffled.

    ``rows`` has row, key, body. A row's place in its input is fixed while the task that
    reads it may be repeated, so a lost executor changes nothing.
    """
    hot = (rows.filter(F.col("key").isNotNull()).groupBy(F.col("key").alias("hot")).agg(F.sum(weight(F.col("body"))).alias("n"))
           .filter(F.col("n") > bucket_bytes / 4).select("hot"))
    marked = rows.withColumn("at", F.monotonically_increasing_id()).join(settle(hot), F.col("key") == F.col("hot"), "left")
    lone = F.col("hot").isNull() & F.col("key").isNotNull()
    hashed = F.when(lone, F.xxhash64(F.lit(seed), "key")).otherwise(F.xxhash64(F.lit(seed), "at"))
    canon = F.xxhash64(F.lit(seed + 1), F.col("key"), F.col("body"), F.when(~lone, F.col("at")))
    return marked.select("row", F.pmod(hashed, F.lit(buckets)).cast("long").alias("bucket"), canon.alias("canon"))


def two_pass_shuffle(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text", seed: int = 29,
                     bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows and columns of ``docs`` with ``shard`` (from 0) and ``slot`` (gapless from 0 per shard).

    The result is written to the shared folder and read back. Null keys and texts, empty
    and very long texts and repeated rows are ordinary rows (a text never leaves its row,
    so a bucket holds its longest text at least); an empty table gives an empty result;
    incoming columns named ``shard`` or ``slot`` are replaced.
    """
    size = docs.agg(F.sum(weight(named(text))).alias("n")).first()["n"] or 0
    buckets = max(1, math.ceil(size / bucket_bytes))
    scattered = scatter(packed(docs, key=named(key), body=named(text)), seed, buckets, bucket_bytes)
    written = settle(scattered.groupBy("bucket").applyInArrow(
        _shuffled(seed), layout(scattered.select("row", "bucket"), place="bigint")))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (written.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
              .select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))
    place = F.col("start") + F.col("place")
    return unpacked(written.join(settle(starts), "bucket"), docs.columns,
                    shard=F.pmod(place, F.lit(shards)).cast("int"), slot=F.floor(place / F.lit(shards)).cast("long"))


def report(sharded: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The digest columns of the contract."""
    return sharded.select(
        named(key), (F.coalesce(F.octet_length(named(text)), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(named(text), F.lit("")).cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
