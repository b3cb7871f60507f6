"""Exact Shapley values of fitted models, in polynomial time.

A tree ensemble is a sum over leaves; a leaf is a box, an interval per input on its path.
With inputs taken from a case in coalition S and from a reference row elsewhere, the leaf
is reached if and only if S holds all inputs that only the case has inside the box (A of
them) and none that only the reference row has inside (B of them). The Shapley value of
that indicator is (A-1)! B! / (A+B)! for the former and -A! (B-1)! / (A+B)! for the latter
inputs, so a case costs one step per leaf and kind of reference row: no coalitions.

Reference rows enter a leaf only by which inputs they have inside the box: they are
counted by that mask. Leaves with their counted masks are cut into chunks and cases into
blocks; each pair meets in a task and the values of a case add up. Leaves stay off the
driver, as a forest has millions.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil, factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fettle import policy as P
from fettle.operators.spread import settle, shared_folder
from fettle.operators.trees import ForestModel

CASES_PER_TASK = 256  # rows of a block: small, much work each
BLOCKS_PER_TASK = 4
WALKED_ROWS = 1 << 13  # rows of a block that walk through trees
CHUNK_NODES = 1 << 18  # of an ensemble's node table held at a time; a tree stays whole
CHUNK_LEAVES = 1 << 12
REFERENCE_ROWS = 1 << 10  # counted at a time
PAIRS = 1 << 20  # (case, leaf, mask) triples worked on at a time


def node_table(model) -> DataFrame:
    """Nodes of a fitted tree ensemble: tree, node, weight, prediction, feature, threshold, left, right."""
    from pyspark.sql import SparkSession

    spark, grown = SparkSession.active(), isinstance(model, ForestModel)
    if grown:
        path = model.folder  # they never were on the driver
    else:
        path = f"{shared_folder(spark)}/trees-{uuid.uuid4().hex}"
        model.write().save(path)
    data = spark.read.parquet(f"{path}/data")
    weights = spark.createDataFrame([(i, float(w)) for i, w in enumerate(model.treeWeights)], "tree int, weight double")
    total = float(sum(model.treeWeights)) if grown or type(model).__name__.startswith("RandomForest") else 1.0
    n = F.col("nodeData")
    return data.select(
        F.col("treeID").alias("tree"), n["id"].alias("node"), n["prediction"].alias("prediction"),
        n["split"]["featureIndex"].alias("feature"), F.get(n["split"]["leftCategoriesOrThreshold"], 0).alias("threshold"),
        n["leftChild"].alias("left"), n["rightChild"].alias("right")).join(F.broadcast(weights), "tree") \
        .withColumn("weight", F.col("weight") / F.lit(total))


def summed(rows: DataFrame, key: str, inputs: Sequence[str], chunks: DataFrame, size: int, outputs: Sequence[str], work) -> DataFrame:
    """``key`` of every row and ``outputs``: the columns of ``work(x, chunk)``, added up over the chunks of a model.

    Every block of ``size`` rows meets every chunk (``chunk bigint, data binary``, pickled) in a task;
    neither rows nor chunks pass the driver. A sum is taken in the order of the chunks.
    """
    names, wide = list(inputs), len(outputs)

    def cut(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for low in range(0, batch.num_rows, size):
                part = batch.slice(low, size)
                x = np.stack([part.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(names))], 1)
                held = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), pa.concat_arrays([part.column(0)]))
                yield pa.RecordBatch.from_arrays([pa.array([number]), held, pa.array([x.tobytes()], pa.binary())], names=["block", "key", "x"])
                number += 1

    kind = rows.schema[key].dataType.simpleString()
    flat = rows.select(F.col(key).alias("key"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)])
    blocks = settle(flat.mapInArrow(cut, f"block bigint, key array<{kind}>, x binary"))

    def met(batches):
        for batch in batches:
            for block, x, chunk, data in batch.itertuples(index=False):
                got = work(np.frombuffer(x).reshape(-1, len(names)), pickle.loads(data))
                yield pd.DataFrame({"block": [block], "chunk": [chunk], "y": [np.ascontiguousarray(got, float).tobytes()]})

    def added(parts):
        y = sum(np.frombuffer(v).reshape(-1, wide) for v in parts.sort_values("chunk")["y"])
        return pd.DataFrame({"block": parts["block"].iloc[:1], **{f"o{i}": [y[:, i]] for i in range(wide)}})

    few = lambda d, by, most: d.repartition(max(1, ceil(d.count() / most)), by)
    pairs = few(blocks.select("block", "x"), "block", BLOCKS_PER_TASK).crossJoin(few(chunks, "chunk", 1).hint("shuffle_replicate_nl"))
    columns = [f"o{i}" for i in range(wide)]
    totals = pairs.mapInPandas(met, "block bigint, chunk bigint, y binary").groupBy("block").applyInPandas(
        added, "block bigint, " + ", ".join(f"{c} array<double>" for c in columns))
    told = blocks.select("block", "key").join(totals, "block").select(F.inline(F.arrays_zip("key", *columns)))
    return told.toDF(key, *outputs)


def walked(rows: DataFrame, model, inputs: Sequence[str], keep: str) -> DataFrame:
    """``keep`` of every row and ``walked``, the weighted sum of the leaves it reaches in the exported node table."""
    table = node_table(model)
    most = table.groupBy("tree").count().agg(F.max("count")).first()[0]
    trees = max(1, CHUNK_NODES // most)

    def packed(part):
        table = part.sort_values(["tree", "node"])
        span = np.int64(table["node"].max() + 1)
        place = table["tree"].to_numpy(np.int64) * span + table["node"].to_numpy(np.int64)  # ascending
        feature, threshold = table["feature"].to_numpy(np.int64), table["threshold"].fillna(0.0).to_numpy(float)
        amount = (table["weight"] * table["prediction"]).to_numpy(float)
        inner = table["left"].to_numpy() >= 0
        left, right = (np.where(inner, np.searchsorted(place, place // span * span + table[side].to_numpy(np.int64)), np.arange(len(place)))
                       for side in ("left", "right"))
        held = (feature.astype(np.int16), threshold, amount, inner, left.astype(np.int32), right.astype(np.int32), np.flatnonzero(place % span == 0))
        return pd.DataFrame({"chunk": [int(table["tree"].iloc[0]) // trees], "data": [pickle.dumps(held)]})

    chunks = settle(table.groupBy((F.col("tree") / trees).cast("long").alias("part")).applyInPandas(packed, "chunk bigint, data binary"))

    def walk(x, held):
        feature, threshold, amount, inner, left, right, roots = held
        total, who = np.zeros(len(x)), np.arange(len(x))
        for root in roots:
            at = np.full(len(x), root)
            while (go := inner[at]).any():
                at = np.where(go, np.where(x[who, feature[at]] <= threshold[at], left[at], right[at]), at)
            total += amount[at]
        return total[:, None]

    return summed(rows.withColumn(keep, F.col(keep).cast("double")), keep, inputs, chunks, WALKED_ROWS, ["walked"], walk)


def leaf_boxes(nodes: DataFrame, inputs: int) -> DataFrame:
    """Leaves as boxes: tree, node, value and per input the interval (low, high]; one join per level of the trees."""
    nodes = settle(nodes)
    wide = lambda x: F.array(*[F.lit(x) for _ in range(inputs)])
    at = nodes.filter("node = 0").select("tree", "node", wide(float("-inf")).alias("low"), wide(float("inf")).alias("high"))
    leaves = []
    while True:
        held = settle(at.join(nodes, ["tree", "node"]))
        leaves.append(held.filter("left < 0").select("tree", "node", (F.col("weight") * F.col("prediction")).alias("value"), "low", "high"))
        inner = held.filter("left >= 0")
        if inner.isEmpty():
            break

        def child(side: str, bound: str):
            other = "low" if bound == "high" else "high"
            best = F.least if bound == "high" else F.greatest
            moved = F.transform(bound, lambda x, i: F.when(i == F.col("feature"), best(x, F.col("threshold"))).otherwise(x))
            return inner.select("tree", F.col(side).alias("node"), moved.alias(bound), F.col(other).alias(other)).select("tree", "node", "low", "high")

        at = child("left", "high").unionByName(child("right", "low"))
    out = leaves[0]
    for more in leaves[1:]:
        out = out.unionByName(more)
    return settle(out)


@dataclass(frozen=True)
class Boxes:
    """Leaves and, per leaf, the counted masks of the reference rows."""

    low: np.ndarray
    high: np.ndarray
    leaf: np.ndarray  # of each pair
    mask: np.ndarray
    amount: np.ndarray  # value times the share of the reference rows


def counted_boxes(low: np.ndarray, high: np.ndarray, value: np.ndarray, reference: np.ndarray) -> Boxes:
    """Boxes of some leaves, the reference rows counted by mask and leaf; an input without bounds is always inside."""
    n = low.shape[1]
    bits, codes, counts = 1 << np.arange(n), np.zeros(0, np.int64), np.zeros(0)
    for at in range(0, len(reference), REFERENCE_ROWS):
        z = reference[at:at + REFERENCE_ROWS]
        mask = sum(((z[:, i] > low[:, i, None]) & (z[:, i] <= high[:, i, None])) * bits[i] for i in range(n))  # leaf x row
        codes, place = np.unique(np.concatenate([codes, (np.arange(len(low))[:, None] << n | mask).ravel()]), return_inverse=True)
        counts = np.bincount(place, np.concatenate([counts, np.ones(mask.size)]))
    leaf = codes >> n
    return Boxes(low, high, leaf, codes & ((1 << n) - 1), value[leaf] * counts / max(1, len(reference)))


def box_chunks(leaves: DataFrame, reference: DataFrame, inputs: Sequence[str]) -> DataFrame:
    """Settled chunks of leaves with their counted masks; the reference rows go to the tasks."""
    z = reference.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"z{i}") for i, c in enumerate(inputs)]).toPandas().to_numpy(float)
    shared = leaves.sparkSession.sparkContext.broadcast(z)

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, len(batch), CHUNK_LEAVES):
                part = batch.iloc[at:at + CHUNK_LEAVES].sort_values(["tree", "node"])
                low, high = (np.array(part[c].tolist(), float).reshape(len(part), -1) for c in ("low", "high"))
                yield pd.DataFrame({"chunk": [number], "data": [pickle.dumps(counted_boxes(low, high, part["value"].to_numpy(float), shared.value))]})
                number += 1

    return settle(leaves.repartition(max(1, ceil(leaves.count() / CHUNK_LEAVES)), "tree", "node").mapInPandas(run, "chunk bigint, data binary"))


def values(x: np.ndarray, boxes: Boxes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Base value, prediction and Shapley values of each row of inputs."""
    m, n = x.shape
    bits = 1 << np.arange(n)
    weight = np.array([[factorial(max(a - 1, 0)) * factorial(b) / factorial(a + b) if a else 0.0 for b in range(n + 1)] for a in range(n + 1)])
    phi, base, prediction = np.zeros((m, n)), np.zeros(m), np.zeros(m)
    full = (1 << n) - 1
    step = max(1, PAIRS // max(1, len(boxes.leaf)))
    for low in range(0, m, step):
        part = x[low:low + step]
        inside = (((part[:, None, :] > boxes.low) & (part[:, None, :] <= boxes.high)) * bits).sum(2)  # case x leaf
        mine, other = inside[:, boxes.leaf], boxes.mask[None, :]
        reach = (mine | other) == full
        plus, minus = mine & ~other & full, other & ~mine
        a, b = np.bitwise_count(plus), np.bitwise_count(minus)
        gain = np.where(reach, boxes.amount * weight[a, b], 0.0)
        loss = np.where(reach, boxes.amount * weight[b, a], 0.0)
        for i in range(n):
            phi[low:low + step, i] = (gain * ((plus >> i) & 1)).sum(1) - (loss * ((minus >> i) & 1)).sum(1)
        base[low:low + step] = np.where(boxes.mask == full, boxes.amount, 0.0).sum()
        prediction[low:low + step] = np.where(mine == full, boxes.amount, 0.0).sum(1)
    return base, prediction, phi


def tree_shapley(cases: DataFrame, reference: DataFrame, model, inputs: Sequence[str] = P.MODEL_INPUTS,
                 key: str = "pseudonym_id") -> DataFrame:
    """Per case base value, prediction (not clipped) and the exact value of every input of a fitted tree ensemble.

    A null input counts as 0, as in scoring.
    """
    chunks = box_chunks(leaf_boxes(node_table(model), len(inputs)), reference, inputs)

    def work(x, boxes):
        base, prediction, phi = values(np.nan_to_num(x, nan=0.0, posinf=np.inf, neginf=-np.inf), boxes)
        return np.column_stack([base, prediction, phi])

    return summed(cases, key, inputs, chunks, CASES_PER_TASK, ["base_value", "prediction", *inputs], work)


def linear_shapley(cases: DataFrame, reference: DataFrame, model: PipelineModel, inputs: Sequence[str] = P.MODEL_INPUTS,
                   key: str = "pseudonym_id") -> DataFrame:
    """The same for a linear model on scaled inputs: weight times the distance from the reference mean."""
    scaler, line = model.stages[-2], model.stages[-1]
    slopes = [w / s if s else 0.0 for w, s in zip(line.coefficients.toArray().tolist(), scaler.std.toArray().tolist())]
    start = line.intercept - sum(b * m for b, m in zip(slopes, scaler.mean.toArray().tolist()))
    x = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in inputs}
    means = reference.agg(*[F.avg(x[c]).alias(f"_m{i}") for i, c in enumerate(inputs)])
    base = sum((F.lit(b) * F.col(f"_m{i}") for i, b in enumerate(slopes)), F.lit(start))
    predicted = sum((F.lit(b) * x[c] for b, c in zip(slopes, inputs)), F.lit(start))
    return cases.join(F.broadcast(means)).select(
        key, base.alias("base_value"), predicted.alias("prediction"),
        *[(F.lit(b) * (x[c] - F.col(f"_m{i}"))).alias(c) for i, (b, c) in enumerate(zip(slopes, inputs))])


def model_shapley(cases: DataFrame, reference: DataFrame, model: PipelineModel, inputs: Sequence[str] = P.MODEL_INPUTS,
                  key: str = "pseudonym_id") -> DataFrame:
    """Exact Shapley values of a deployed pipeline, by leaves for trees and in closed form for linear models."""
    last = model.stages[-1]
    if hasattr(last, "treeWeights"):
        return tree_shapley(cases, reference, last, inputs, key)
    return linear_shapley(cases, reference, model, inputs, key)
