"""Order-dependent work that must not gather a group in one task.

A group (person, unit, signal...) may hold a large share of all rows. Plain
``partitionBy(group)`` windows and the exact ``percentile`` aggregate would put
it in one task, so the operators here range-partition on the *full* sort key
and carry only per-slice totals between slices.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Where it is unset a local session (tests) gets a folder of its own; on a
    cluster the setting is required.
    """
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="fettle-checkpoint-")
    sc.setCheckpointDir(configured)
    return sc._jsc.sc().getCheckpointDir().get()


def settle(df: DataFrame) -> DataFrame:
    """Write once to the shared folder and read the table back.

    Later reads survive lost executors, prune columns, and know the real size,
    so the optimizer can choose broadcast joins by itself. (``checkpoint`` would
    compute the plan twice and hide the size.)
    """
    path = f"{shared_folder(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Remove what this session has settled, fitted forests that were not saved too; call it when the results are read or written."""
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                   measure: str | None = None, out: str = "running") -> DataFrame:
    """Inclusive running sum of ``measure`` (or row number) per key, in ``order``.

    ``(keys, order)`` must be unique. Rows are range-partitioned on all of it, so
    one hot key spans many slices; each slice sums itself and receives the total
    of the slices before it.
    """
    keys, order = list(keys), list(order)
    amount = F.lit(1).cast("long") if measure is None else F.col(measure)
    sliced = settle(
        df.repartitionByRange(*[F.col(c) for c in keys + order])
        .withColumn("_slice", F.spark_partition_id())
    )
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        sliced.groupBy(*keys, "_slice").agg(F.sum(amount).alias("_sum"))
        .withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
        .drop("_sum")
    )
    inside = (
        Window.partitionBy(*keys, "_slice").orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        sliced.withColumn("_inside", F.sum(amount).over(inside))
        .join(carried, [*keys, "_slice"])
        .withColumn(out, F.col("_before") + F.col("_inside"))
        .drop("_slice", "_before", "_inside")
    )


def order_statistics(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values per key with ``ties`` and the cumulative count ``upto``."""
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, value).agg(F.count(F.lit(1)).alias("ties"))
    )
    return running_totals(counts, keys, [value], "ties", "upto")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str,
                    probs: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles per key, exact, without gathering a key."""
    keys = list(keys)
    stats = order_statistics(df, keys, value)
    totals = stats.groupBy(*keys).agg(F.max("upto").alias("_n"))
    joined = stats.join(totals, keys) if keys else stats.crossJoin(F.broadcast(totals))
    picks, outs = [], []
    for name, prob in probs.items():
        at = (F.col("_n") - 1) * F.lit(float(prob))
        low, high = F.floor(at) + 1, F.ceil(at) + 1
        picks += [
            F.min(F.when(F.col("upto") >= low, F.col(value))).alias(f"_{name}_lo"),
            F.min(F.when(F.col("upto") >= high, F.col(value))).alias(f"_{name}_hi"),
            F.max(at - F.floor(at)).alias(f"_{name}_frac"),
        ]
        lo, hi, frac = (F.col(f"_{name}_{part}") for part in ("lo", "hi", "frac"))
        outs.append((lo + (hi - lo) * frac).alias(name))
    return joined.groupBy(*keys).agg(*picks).select(*keys, *outs)


def kth_smallest(df: DataFrame, value: str, rank: Column, extra: DataFrame) -> DataFrame:
    """Value of the row at 1-based ``rank`` (a column of the one-row ``extra``)."""
    stats = order_statistics(df, [], value)
    return (
        stats.crossJoin(F.broadcast(extra))
        .filter(F.col("upto") >= rank)
        .groupBy(*extra.columns).agg(F.min(value).alias(value))
    )


def tied_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """One row per distinct value with its averaged rank over the whole data."""
    stats = order_statistics(df, [], value)
    return stats.select(value, (F.col("upto") - (F.col("ties") - 1) / F.lit(2.0)).alias(out))


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "position") -> DataFrame:
    """1-based position per key; the distributed form of ``row_number``."""
    return running_totals(df, keys, order, None, out)
