"""Tree ensembles of MLlib's kind, grown in few jobs.

MLlib plans every level of every tree on the driver, so a forest of deep trees costs by its
nodes, and a round of boosting is a chain of jobs. Here rows are binned once (cut points by
MLlib's rule) and kept as blocks.

* Forest: a node with more than ``SUBTREE_ROWS`` rows is split by histograms that the blocks
  add up; the rows of any smaller node meet in one task, which grows the whole subtree.
* Boosting: one stage. A task holds its share of the blocks through all rounds; where there are
  several (a barrier stage) they exchange histograms level by level and so take the same splits.
  Such an exchange takes Spark most of a second whatever its size, so a task holds as many rows
  as its memory allows, some 130 bytes each, and counts several inputs in one pass.

Bootstrap, subsets of the inputs, losses, step and limits are those of the MLlib estimators.
Fitted boosting is MLlib's model. A forest has up to trees x 2^(depth + 1) nodes, which MLlib's
model would hold on the driver as objects: ``ForestModel`` leaves them in MLlib's storage
format in the shared folder, and scores with two bytes a node and a double a leaf.
"""

from __future__ import annotations

import base64
import json
import pickle
import time
import uuid
from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.base import _PredictorParams
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (
    GBTRegressionModel, GBTRegressor, RandomForestRegressionModel, RandomForestRegressor, _RandomForestRegressorParams,
)
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fettle.operators.spread import settle, shared_folder

BLOCK_ROWS = 1 << 14
SUBTREE_ROWS = 1 << 17  # rows of a subtree grown in one task
BOOSTING_ROWS = 1 << 22  # rows a boosting task holds
CELLS = 1 << 16  # joint bins counted in one pass
SENT_NODES = 1 << 18  # nodes of a forest that the driver holds at a time
NODE = "tree int, heap bigint, n double, total double, squares double, gain double, feature int, bin int"
_NODE = ("tree", "heap", "n", "total", "squares", "gain", "feature", "bin")


def cut_points(values: np.ndarray, bins: int) -> np.ndarray:
    """MLlib's cut points of a continuous input: between all distinct values, or near equal counts."""
    seen, counts = np.unique(values[~np.isnan(values)], return_counts=True)
    middle = (seen[:-1] + seen[1:]) / 2
    if len(middle) < bins:
        return middle
    stride, upto, out = counts.sum() / bins, np.cumsum(counts), []
    target = stride
    for i in range(1, len(seen)):
        if abs(upto[i - 1] - target) < abs(upto[i] - target):
            out.append(middle[i - 1])
            target += stride
    return np.array(out[:bins - 1])


class Binned:
    """Rows as settled blocks of bin numbers and labels."""

    def __init__(self, rows: DataFrame, features: str, label: str, bins: int, seed: int):
        flat = rows.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"))
        y, odd = F.col("y"), F.exists("x", lambda v: F.isnan(v) | (F.abs(v) == float("inf")))
        size = flat.agg(F.count(F.lit(1)).alias("n"), F.count_if(y.isNull() | F.isnan(y)).alias("labels"),
                        F.count_if(F.col("x").isNull() | odd).alias("inputs")).first()
        self.rows = size["n"]
        # as MLlib refuses them
        if not self.rows or size["labels"]:
            raise ValueError("labels are needed, and none may be null or NaN")
        if size["inputs"]:
            raise ValueError("inputs must not be null, NaN or infinite")
        # as in MLlib, cut points come from a sample of this size; every row is binned and fitted
        needed = max(bins * bins, 10_000)
        part = flat if self.rows <= needed else flat.sample(False, needed / self.rows, seed)
        sample = np.array(part.select("x").toPandas()["x"].tolist(), float)
        self.cuts = [cut_points(sample[:, i], bins) for i in range(sample.shape[1])]
        cuts = self.cuts

        def run(batches):
            from pyspark import TaskContext

            number = TaskContext.get().partitionId() << 32
            for batch in batches:
                x, y = np.array(batch["x"].tolist(), float).reshape(-1, len(cuts)), batch["y"].to_numpy(float)
                for low in range(0, len(y), BLOCK_ROWS):
                    to = slice(low, low + BLOCK_ROWS)
                    binned = np.stack([np.searchsorted(c, x[to, i]) for i, c in enumerate(cuts)], 1).astype(np.uint8)
                    yield pd.DataFrame({"block": [number], "x": [binned.tobytes()], "y": [y[to].tobytes()]})
                    number += 1

        self.blocks = settle(flat.mapInPandas(run, "block bigint, x binary, y binary"))

    @property
    def inputs(self) -> int:
        return len(self.cuts)

    @property
    def bins(self) -> int:
        return max(1, *(len(c) for c in self.cuts)) + 1


def _best(h0: np.ndarray, h1: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of histograms (..., bin) of counts and sums: the gain of the best cut, the cut, and count and sum left of it."""
    left0, left1 = np.cumsum(h0, -1)[..., :-1], np.cumsum(h1, -1)[..., :-1]
    n, total = h0.sum(-1)[..., None], h1.sum(-1)[..., None]
    right0, right1 = n - left0, total - left1
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (left1 ** 2 / left0 + right1 ** 2 / right0 - total ** 2 / n) / n
    gain = np.where((left0 >= least) & (right0 >= least), gain, -np.inf)
    cut = gain.argmax(-1)
    take = lambda a: np.take_along_axis(a, cut[..., None], -1)[..., 0]
    return take(gain), cut, take(left0), take(left1)


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, root: int, bins: int, depth: int, least: int, take: int, seed: list[int]) -> list[np.ndarray]:
    """The subtree at heap number ``root`` (children of i: 2 i, 2 i + 1) from all its rows; columns from ``heap`` on."""
    rng, inputs = np.random.default_rng([*seed, root]), x.shape[1]
    at, heaps, wy = np.zeros(len(y), np.int64), np.array([root], np.int64), w * y
    wyy, out = wy * y, []
    while len(heaps):
        k = len(heaps)
        n, total, squares = (np.bincount(at, v, k) for v in (w, wy, wyy))
        gain, feature, cut = np.full(k, -1.0), np.full(k, -1), np.zeros(k, np.int64)
        if int(heaps[0]).bit_length() <= depth:
            asked = rng.random((k, inputs)).argsort(1)[:, :take]
            for j in range(take):
                cell = at * bins + x[np.arange(len(y)), asked[at, j]]
                h0, h1 = (np.bincount(cell, v, k * bins).reshape(k, bins) for v in (w, wy))
                g, c, _, _ = _best(h0, h1, least)
                better = g > np.maximum(gain, squares / n * 1e-12)
                gain[better], feature[better], cut[better] = g[better], asked[better, j], c[better]
        inner = feature >= 0
        out.append(np.stack([heaps, n, total, squares, gain, feature, cut]))
        place = np.cumsum(inner) - 1
        keep = inner[at]
        at, x, y, w, wy, wyy = at[keep], x[keep], y[keep], w[keep], wy[keep], wyy[keep]
        right = x[np.arange(len(y)), feature[at]] > cut[at]
        at = 2 * place[at] + right
        heaps = np.stack([2 * heaps[inner], 2 * heaps[inner] + 1], 1).ravel()
    return list(np.concatenate(out, 1))


def _frame(tree, columns) -> pd.DataFrame:
    return pd.DataFrame(dict(zip(_NODE, [np.full(len(columns[0]), tree), *columns]))).astype(
        {"tree": np.int32, "heap": np.int64, "feature": np.int32, "bin": np.int32})


class SubtreeForest(RandomForestRegressor):
    """MLlib's random forest for variance, small subtrees grown whole in a task."""

    def _fit(self, rows: DataFrame) -> "ForestModel":
        data = Binned(rows, self.getFeaturesCol(), self.getLabelCol(), self.getMaxBins(), self.getSeed())
        nodes = forest_nodes(data, self.getNumTrees(), self.getMaxDepth(), self.getMinInstancesPerNode(),
                             self.getSubsamplingRate(), self.getSeed())
        folder = stored(self, RandomForestRegressionModel, nodes, data, [1.0] * self.getNumTrees())
        return self._copyValues(ForestModel(folder, data.inputs)._resetUid(self.uid))


LEAF = 255  # in place of an input


@dataclass(frozen=True)
class GrownTree:
    """What the driver keeps of a tree."""

    depth: int
    numNodes: int


class ForestModel(Model, _PredictorParams, _RandomForestRegressorParams, MLReadable, MLWritable):
    """A fitted random forest whose nodes stay in a folder, in the storage format of MLlib's model.

    To score, the trees go to the tasks packed, breadth first: per node the input and the number
    of the threshold among those of that input, per leaf its value. The nodes of a forest just
    fitted lie in the shared folder of the session until it is cleared; ``save`` copies them.
    """

    def __init__(self, folder: str = "", inputs: int = 0):
        super().__init__()
        self.folder, self.numFeatures, self._sent = folder, inputs, None

    @property
    def treeWeights(self) -> list[float]:
        return [1.0] * self.getNumTrees()

    @property
    def trees(self) -> list[GrownTree]:
        return self._packed()[2]

    @property
    def totalNumNodes(self) -> int:
        return sum(t.numNodes for t in self.trees)

    def mllib(self) -> RandomForestRegressionModel:
        """MLlib's own model of the same nodes, all of them objects on the driver."""
        return RandomForestRegressionModel.load(self.folder)

    def _packed(self):
        """Packed trees as broadcasts of at most ``SENT_NODES`` nodes, and the size of each tree; made when first asked for."""
        if self._sent is None:
            from pyspark.sql import SparkSession

            spark, n = SparkSession.active(), F.col("nodeData")
            nodes = spark.read.parquet(f"{self.folder}/data").select(
                F.col("treeID").alias("tree"), n["id"].alias("id"), n["prediction"].alias("value"), n["leftChild"].alias("left"),
                n["split"]["featureIndex"].alias("feature"), F.get(n["split"]["leftCategoriesOrThreshold"], 0).alias("threshold"))
            trees = max(1, SENT_NODES // nodes.groupBy("tree").count().agg(F.max("count")).first()[0])
            # at most a threshold per bin and input
            points = nodes.filter("left >= 0").select("feature", "threshold").distinct().collect()
            cuts = [np.sort([p.threshold for p in points if p.feature == i]) for i in range(self.numFeatures)]

            def pack(parts):
                out = []
                for _, part in parts.sort_values("id").groupby("tree"):
                    inner, feature = part["left"].to_numpy() >= 0, part["feature"].to_numpy()
                    spot = np.zeros(len(part), np.uint8)
                    for i, c in enumerate(cuts):
                        mine = inner & (feature == i)
                        spot[mine] = np.searchsorted(c, part["threshold"].to_numpy(float)[mine])
                    left = 2 * np.cumsum(inner) - 1
                    if not np.array_equal(left[inner], part["left"].to_numpy()[inner]):
                        raise ValueError("nodes are not stored breadth first")
                    at, depth = np.flatnonzero(inner[:1]), 0
                    while len(at):
                        depth, at = depth + 1, np.concatenate([left[at], left[at] + 1])
                        at = at[inner[at]]
                    out.append((depth, np.where(inner, feature, LEAF).astype(np.uint8), spot, part["value"].to_numpy(float)[~inner]))
                return pd.DataFrame({"part": [int(parts["tree"].iloc[0]) // trees], "data": [pickle.dumps(out)]})

            part = (F.col("tree") / trees).cast("long")
            packed = nodes.repartition(ceil(self.getNumTrees() / trees), part).groupBy(part.alias("part")).applyInPandas(pack, "part bigint, data binary")
            sent = {}
            for row in packed.toLocalIterator():  # a partition at a time, and none is kept here
                some = pickle.loads(row["data"])
                sent[row["part"]] = spark.sparkContext.broadcast(some), [GrownTree(t[0], len(t[1])) for t in some]
            parts = [sent[k] for k in sorted(sent)]
            self._sent = cuts, [shared for shared, _ in parts], [t for _, sizes in parts for t in sizes]
        return self._sent

    def _transform(self, rows: DataFrame) -> DataFrame:
        (cuts, sent, sizes), inputs = self._packed(), self.numFeatures
        count = len(sizes)

        def told(x: pd.Series) -> pd.Series:
            x = np.array(x.tolist(), float).reshape(-1, inputs)
            binned = np.stack([np.searchsorted(c, x[:, i]) for i, c in enumerate(cuts)], 1).astype(np.uint8)
            return pd.Series(votes(binned, (tree for shared in sent for tree in shared.value)) / count)

        score = F.pandas_udf(told, "double")
        return rows.withColumn(self.getPredictionCol(), score(vector_to_array(self.getFeaturesCol())))

    def write(self) -> MLWriter:
        return _ForestWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ForestReader()


def votes(x: np.ndarray, packed) -> np.ndarray:
    """Sum of the trees for rows of bin numbers; a row on a leaf stays there."""
    start, flat, total = np.arange(len(x)) * x.shape[1], x.ravel(), np.zeros(len(x))
    for depth, feature, spot, value in packed:
        inner = feature != LEAF
        left = np.where(inner, 2 * np.cumsum(inner) - 1, np.arange(len(inner)))
        feature, spot = np.where(inner, feature, 0).astype(np.int64), np.where(inner, spot, 255).astype(np.uint8)
        amount = np.zeros(len(inner))
        amount[~inner] = value
        at = np.zeros(len(x), np.int64)
        for _ in range(depth):
            at = left[at] + (flat[start + feature[at]] > spot[at])
        total += amount[at]
    return total


class _ForestWriter(MLWriter):
    def __init__(self, model: ForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata={"numFeatures": self.model.numFeatures})
        read, to = self.sparkSession.read, f"{path}/nodes"
        for part in ("data", "treesMetadata"):
            read.parquet(f"{self.model.folder}/{part}").write.parquet(f"{to}/{part}")
        read.text(f"{self.model.folder}/metadata").coalesce(1).write.text(f"{to}/metadata")


class _ForestReader(MLReader):
    def load(self, path: str) -> ForestModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = ForestModel(f"{path}/nodes", metadata["numFeatures"])._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


def forest_nodes(data: Binned, trees: int, depth: int, least: int, rate: float, seed: int) -> DataFrame:
    """Nodes of all trees; a third of the inputs is tried at a node, rows are drawn with replacement."""
    spark, inputs, bins = data.blocks.sparkSession, data.inputs, data.bins
    take = ceil(inputs / 3) if trees > 1 else inputs
    seed, slots = seed & 0x7FFFFFFF, spark.sparkContext.defaultParallelism
    top: dict[int, dict[int, tuple[int, int]]] = {}  # splits of the large nodes, by tree and heap number
    made: list[tuple] = []
    large = {(t, 1) for t in range(trees)} if data.rows > SUBTREE_ROWS else set()

    def drawn(block, tree, splits):
        """Rows of a block that a tree draws, with the node each lies in below the splits made so far."""
        x, y = np.frombuffer(block.x, np.uint8).reshape(-1, inputs), np.frombuffer(block.y)
        w = np.random.default_rng([seed, tree, block.block]).poisson(rate, len(y))
        hit = np.flatnonzero(w)
        x, y, w, at = x[hit], y[hit], w[hit], np.ones(len(hit), np.int64)
        if splits:
            feature, cut = np.full(2 * max(splits) + 2, -1), np.zeros(2 * max(splits) + 2, np.int64)
            for heap, (f, c) in splits.items():
                feature[heap], cut[heap] = f, c
            for _ in range(max(splits).bit_length()):
                f = feature[at]
                at = np.where(f >= 0, 2 * at + (x[np.arange(len(at)), f] > cut[at]), at)
        return x, y, w, at

    while large:
        asked, splits = sorted(large), {t: dict(s) for t, s in top.items()}

        def counted(batches, asked=asked, splits=splits):
            spots = {}
            for t, heap in asked:
                spots.setdefault(t, []).append(heap)
            sums = {}
            for batch in batches:
                for block in batch.itertuples():
                    for t, heaps in spots.items():
                        x, y, w, at = drawn(block, t, splits.get(t))
                        order = np.searchsorted(heaps, at).clip(0, len(heaps) - 1)
                        mine = np.array(heaps)[order] == at
                        x, y, w, order = x[mine], y[mine], w[mine], order[mine]
                        shape = (len(heaps), inputs, bins)
                        cell = ((order[:, None] * inputs + np.arange(inputs)) * bins + x).ravel()
                        got = np.stack([np.bincount(cell, np.repeat(v, inputs), np.prod(shape)).reshape(shape) for v in (w, w * y, w * y * y)], 1)
                        sums[t] = sums[t] + got if t in sums else got
            for t, heaps in spots.items():
                if t in sums:
                    yield pd.DataFrame({"tree": t, "heap": heaps, "sums": [s.tobytes() for s in sums[t]]})

        def split(key, parts):
            h = sum(np.frombuffer(s).reshape(3, inputs, bins) for s in parts["sums"])
            n, total, squares = h[:, 0].sum(1)
            among = np.random.default_rng([seed, *key]).permutation(inputs)[:take]
            gain, cut, left, _ = _best(h[0, among], h[1, among], least)
            best, leaf = int(gain.argmax()), gain.max() <= squares / n * 1e-12
            out = _frame(key[0], [[key[1]], [n], [total], [squares], [-1.0 if leaf else gain[best]], [-1 if leaf else among[best]], [cut[best]]])
            return out.assign(left=left[best])

        sums = data.blocks.repartition(slots).mapInPandas(counted, "tree int, heap bigint, sums binary")
        # one row a node; their number is that of the rows drawn over SUBTREE_ROWS
        level = sums.groupBy("tree", "heap").applyInPandas(split, NODE + ", left double").collect()
        large = set()
        for r in level:
            made.append(tuple(r)[:-1])
            if r["feature"] < 0:
                continue
            top.setdefault(r["tree"], {})[r["heap"]] = (r["feature"], r["bin"])
            for heap, size in ((2 * r["heap"], r["left"]), (2 * r["heap"] + 1, r["n"] - r["left"])):
                if size > SUBTREE_ROWS and heap.bit_length() <= depth:
                    large.add((r["tree"], heap))

    done = {(r[0], r[1]) for r in made}

    def dealt(batches):
        for batch in batches:
            for block in batch.itertuples():
                for t in range(trees):
                    x, y, w, at = drawn(block, t, top.get(t))
                    order = at.argsort(kind="stable")
                    heaps, starts = np.unique(at[order], return_index=True)
                    parts = [p for p in np.split(order, starts[1:])] if len(heaps) else []
                    yield pd.DataFrame([(t, int(h), x[p].tobytes(), y[p].tobytes(), w[p].tobytes()) for h, p in zip(heaps, parts) if (t, int(h)) not in done],
                                       columns=["tree", "heap", "x", "y", "w"])

    def grown(key, parts):
        x = np.frombuffer(b"".join(parts["x"]), np.uint8).reshape(-1, inputs)
        y, w = np.frombuffer(b"".join(parts["y"])), np.frombuffer(b"".join(parts["w"]), np.int64).astype(float)
        return _frame(key[0], grow(x, y, w, int(key[1]), bins, depth, least, take, [seed, int(key[0])]))

    small = data.blocks.repartition(slots).mapInPandas(dealt, "tree int, heap bigint, x binary, y binary, w binary")
    # few rows carry much work: partitions by number, not by bytes
    nodes = small.repartition(4 * slots, "tree", "heap").groupBy("tree", "heap").applyInPandas(grown, NODE)
    return nodes.unionByName(spark.createDataFrame(made, NODE)) if made else nodes


class BarrierBoosting(GBTRegressor):
    """MLlib's gradient boosting for squared error, all rounds in one barrier stage."""

    def _fit(self, rows: DataFrame) -> GBTRegressionModel:
        data = Binned(rows, self.getFeaturesCol(), self.getLabelCol(), self.getMaxBins(), self.getSeed())
        weights = [1.0] + [self.getStepSize()] * (self.getMaxIter() - 1)
        nodes = boosted_nodes(data, weights, self.getMaxDepth(), self.getMinInstancesPerNode(), self.getSubsamplingRate(), self.getSeed())
        # its nodes are few: rounds x 2^(depth + 1) at most
        return GBTRegressionModel.load(stored(self, GBTRegressionModel, nodes, data, weights))


def boosted_nodes(data: Binned, weights: list[float], depth: int, least: int, rate: float, seed: int) -> DataFrame:
    inputs, widths = data.inputs, [len(c) + 1 for c in data.cuts]
    slots = data.blocks.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(slots, ceil(data.rows / BOOSTING_ROWS)))
    seed = seed & 0x7FFFFFFF

    def run(batches):
        from pyspark import BarrierTaskContext, TaskContext

        part = TaskContext.get().partitionId()

        def everywhere(mine: np.ndarray) -> np.ndarray:
            """The sum over all tasks, added in the same order by each; Spark takes most of a second for it."""
            if tasks == 1:
                return mine
            told = BarrierTaskContext.get().allGather(base64.b64encode(mine.tobytes()).decode())
            return sum(np.frombuffer(base64.b64decode(m)) for m in told).reshape(mine.shape)

        # blocks in their order, so that sums do not depend on how they came
        blocks = sorted((b for batch in batches for b in batch.itertuples()), key=lambda b: b.block)
        x = np.concatenate([np.frombuffer(b.x, np.uint8).reshape(-1, inputs) for b in blocks] or [np.zeros((0, inputs), np.uint8)])
        y = np.concatenate([np.frombuffer(b.y) for b in blocks] or [np.zeros(0)])
        del blocks
        for tree, columns in boost(x, y, widths, weights, depth, least, rate, [seed, part], everywhere):
            if part == 0:
                yield _frame(tree, columns)

    return settle(data.blocks.repartition(tasks).mapInPandas(run, NODE, barrier=tasks > 1))


def joined_inputs(x: np.ndarray, widths: list[int]) -> list[tuple[list[int], np.ndarray]]:
    """Inputs whose bins are counted together, and the joint bin number of each row: one pass serves them all."""
    room, out = min(CELLS, len(x) // 8), []
    for i, width in enumerate(widths):
        if out and np.prod([widths[j] for j in out[-1]]) * width <= room:
            out[-1].append(i)
        else:
            out.append([i])
    kind = np.uint16 if max(CELLS, *widths) <= 1 << 16 else np.int64
    return [(some, np.ravel_multi_index([x[:, i] for i in some], [widths[i] for i in some]).astype(kind)) for some in out]


def boost(x: np.ndarray, y: np.ndarray, widths: list[int], weights: list[float], depth: int, least: int, rate: float, seed: list[int], everywhere):
    """Each tree and its nodes (columns from ``heap`` on), from the share of the rows at hand.

    ``everywhere`` adds an array up over all shares: once a level, in all shares alike. Of two
    children only the one with fewer rows is counted, the other is what is left of the parent.
    """
    inputs, bins = len(widths), max(2, *widths)
    groups, columns, score, rng = joined_inputs(x, widths), np.ascontiguousarray(x.T), np.zeros(len(y)), np.random.default_rng(seed)
    flat, whole = x.ravel(), None

    def counted(rows, t, counts=None):
        h = np.zeros((2, inputs, bins))
        for some, code in groups:
            cell, shape = code if rows is None else code[rows], [widths[i] for i in some]
            cell = cell.astype(np.int64)
            for k, v in ((0, None), (1, t)):
                if k == 0 and counts is not None:
                    continue
                sums = np.bincount(cell, v, int(np.prod(shape))).reshape(shape)
                for j, i in enumerate(some):
                    h[k, i, :widths[i]] = sums.sum(tuple(a for a in range(len(some)) if a != j))
        if counts is not None:
            h[0] = counts
        return h

    waiting, leaves = None, np.zeros(0)  # of the tree before: its nodes, and the sums of squares of its last leaves
    for tree, weight in enumerate(weights):
        target = 2 * (y - score) if tree else y
        drawn = rng.random(len(y)) < rate if rate < 1 else None
        rows = None if drawn is None else np.flatnonzero(drawn)
        t = target if rows is None else target[rows]
        h = counted(rows, t, whole)
        if rows is None:
            whole = h[0]
        got = everywhere(np.concatenate([h.ravel(), [t @ t], leaves]))
        if waiting is not None:
            yield tree - 1, _with_squares(*waiting, got[h.size + 1:])
        h, squares = got[:h.size].reshape(1, 2, inputs, bins), got[h.size:h.size + 1]
        heaps, held, nodes = np.ones(1, np.int64), [(rows, t)], []  # of a level: heap numbers, rows and targets
        feature_of, cut_of, value_of = np.full(2 << depth, -1), np.zeros(2 << depth, np.int64), np.zeros(2 << depth)
        last, leaves = np.zeros(0, np.int64), np.zeros(0)
        for level in range(depth):
            k = len(heaps)
            n, total = h[:, 0, 0].sum(1), h[:, 1, 0].sum(1)
            gains, cuts, left0, left1 = _best(h[:, 0], h[:, 1], least)
            feature = gains.argmax(1)
            pick = np.arange(k), feature
            gain, cut, left0, left1 = gains[pick], cuts[pick], left0[pick], left1[pick]
            inner = gain > np.where(n > 0, squares / np.maximum(n, 1), 0) * 1e-12
            feature = np.where(inner, feature, -1)
            feature_of[heaps], cut_of[heaps], value_of[heaps] = feature, cut, total / np.maximum(n, 1)
            nodes.append(np.stack([heaps, n, total, squares, np.where(inner, gain, -1.0), feature, cut]))
            below = []
            for place, (rows, t) in enumerate(held):
                if not inner[place]:
                    _add(score, rows, weight * value_of[heaps[place]])
                    continue
                column = columns[feature[place]]
                right = (column if rows is None else column[rows]) > cut[place]
                for side in (~right, right):
                    below.append((np.flatnonzero(side) if rows is None else rows[side], t[side]))
            held = below
            up = np.flatnonzero(inner)
            heaps = np.stack([2 * heaps[up], 2 * heaps[up] + 1], 1).ravel()
            child_n = np.stack([left0[up], n[up] - left0[up]], 1)
            child_total = np.stack([left1[up], total[up] - left1[up]], 1)
            if not len(heaps):
                break
            if level + 1 < depth:
                small = (child_n[:, 1] < child_n[:, 0]).astype(int)
                mine = [held[2 * i + s] for i, s in enumerate(small)]
                part = np.stack([counted(*m) for m in mine])
                got = everywhere(np.concatenate([part.ravel(), [t @ t for _, t in mine]]))
                part, some = got[:part.size].reshape(part.shape), got[part.size:]
                at = np.arange(len(up))
                h, squares = (_beside(small, at, a, b[up] - a) for a, b in ((part, h), (some, squares)))
            else:
                last, leaves = heaps, np.array([t @ t for _, t in held])
                value_of[heaps] = child_total.ravel() / np.maximum(child_n.ravel(), 1)
                for heap, (rows, _) in zip(heaps, held):
                    _add(score, rows, weight * value_of[heap])
                nodes.append(np.stack([heaps, child_n.ravel(), child_total.ravel(), np.zeros(len(heaps)), np.full(len(heaps), -1.0),
                                       np.full(len(heaps), -1), np.zeros(len(heaps))]))
        if drawn is not None:
            rows = np.flatnonzero(~drawn)
            at, start = np.ones(len(rows), np.int64), rows * inputs
            for _ in range(depth):
                f = feature_of[at]
                at = np.where(f >= 0, 2 * at + (flat[start + f] > cut_of[at]), at) if len(at) else at
            score[rows] += weight * value_of[at]
        waiting = nodes, len(last)
    yield len(weights) - 1, _with_squares(*waiting, everywhere(leaves) if len(leaves) else leaves)


def _add(score: np.ndarray, rows: np.ndarray | None, amount: float) -> None:
    if rows is None:
        score += amount
    else:
        score[rows] += amount


def _beside(small: np.ndarray, at: np.ndarray, counted: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Children in their order, from the counted one of each pair and the other."""
    out = np.empty((len(at), 2, *counted.shape[1:]))
    out[at, small], out[at, 1 - small] = counted, rest
    return out.reshape(2 * len(at), *counted.shape[1:])


def _with_squares(nodes: list[np.ndarray], leaves: int, squares: np.ndarray) -> list[np.ndarray]:
    if leaves:
        nodes[-1][3] = squares
    return list(np.concatenate(nodes, 1))


def stored(stage, kind, nodes: DataFrame, data: Binned, weights: list[float]) -> str:
    """The folder that holds the nodes in the storage format of MLlib's model."""
    spark, path = nodes.sparkSession, f"{shared_folder(nodes.sparkSession)}/grown-{uuid.uuid4().hex}"
    cuts = data.cuts

    def numbered(key, part):
        part = part.sort_values("heap")
        heap, inner = part["heap"].to_numpy(), part["feature"].to_numpy() >= 0
        child = np.searchsorted(heap, 2 * heap)
        threshold = [[float(cuts[f][b])] if f >= 0 else [] for f, b in zip(part["feature"], part["bin"])]
        mean = part["total"] / part["n"]
        return pd.DataFrame({
            "tree": part["tree"], "id": np.arange(len(part)), "prediction": mean, "impurity": np.maximum(part["squares"] / part["n"] - mean ** 2, 0.0),
            "stats": part[["n", "total", "squares"]].to_numpy().tolist(), "n": part["n"].round().astype(np.int64), "gain": part["gain"],
            "left": np.where(inner, child, -1), "right": np.where(inner, child + 1, -1), "feature": part["feature"], "threshold": threshold})

    schema = ("tree int, id int, prediction double, impurity double, stats array<double>, n bigint, gain double, left int, "
              "right int, feature int, threshold array<double>")
    slots = spark.sparkContext.defaultParallelism
    rows = nodes.repartition(slots, "tree").groupBy("tree").applyInPandas(numbered, schema)  # a tree is bounded by its depth
    c = F.col
    rows.select(c("tree").alias("treeID"), F.struct(
        "id", "prediction", "impurity", c("stats").alias("impurityStats"), c("n").alias("rawCount"), "gain", c("left").alias("leftChild"),
        c("right").alias("rightChild"), F.struct(c("feature").alias("featureIndex"), c("threshold").alias("leftCategoriesOrThreshold"),
                                                 F.lit(-1).alias("numCategories")).alias("split")).alias("nodeData")).write.parquet(f"{path}/data")

    def about(name: str, uid: str, params: dict, **more) -> str:
        return json.dumps({"class": f"org.apache.spark.ml.regression.{name}", "timestamp": int(time.time() * 1000), "sparkVersion": spark.version,
                           "uid": uid, "paramMap": params, "defaultParamMap": {}, **more})

    own = {p.name: v for p, v in stage.extractParamMap().items()}
    one = {k: own[k] for k in ("featuresCol", "labelCol", "predictionCol", "maxDepth", "maxBins", "minInstancesPerNode")}
    trees = [(t, about("DecisionTreeRegressionModel", f"dtr_{uuid.uuid4().hex[:12]}", one), float(w)) for t, w in enumerate(weights)]
    spark.createDataFrame(trees, "_1 int, _2 string, _3 double").write.parquet(f"{path}/treesMetadata")
    line = about(kind.__name__, stage.uid, own, numFeatures=data.inputs, numTrees=len(weights))
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    return path
