"""Spark's random forest for many rows: grown level by level from a written table of bins, a byte per value.

Spark's own fit keeps an object with a number per tree for every row and goes over all of them for each group of nodes.
Here a job grows a level of as many trees as their histograms allow: every task counts the classes of its rows per node,
feature and bin, the counts are added up by tree, and the best cut of each node comes back. How often a row takes part in a
tree is drawn (Poisson, as Spark draws) by tree and block, so a task that is repeated draws the same. The nodes become a
model of Spark's, which predicts and is stored as any other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.operators.boosting import bin_edges, ends
from palisade.session import materialize, new_path

BLOCK_ROWS = 1 << 17
#: Rows of a task of a job, and bytes of the histograms that it holds at a time.
TASK_ROWS, GROUP_BYTES = 4_000_000, 64 << 20
_NODE = (
    "treeID int, nodeData struct<id:int,prediction:double,impurity:double,impurityStats:array<double>,rawCount:bigint,gain:double,"
    "leftChild:int,rightChild:int,split:struct<featureIndex:int,leftCategoriesOrThreshold:array<double>,numCategories:int>>"
)


def gini(counts: np.ndarray) -> np.ndarray:
    """Impurity of class counts (last axis)."""
    total = counts.sum(axis=-1)
    return 1 - (counts**2).sum(axis=-1) / np.maximum(total, 1) ** 2


@dataclass
class Tree:
    """Nodes by level; feature -1: leaf, last bin of the left side, left child (the right one follows), gain, class counts."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    gain: list[float] = field(default_factory=lambda: [-1.0])
    counts: list[np.ndarray | None] = field(default_factory=lambda: [None])
    active: list[int] = field(default_factory=lambda: [0])

    def arrays(self) -> tuple[np.ndarray, ...]:
        return np.array(self.feature, np.int16), np.array(self.cut, np.uint8), np.array(self.left), None

    def grow(self, cuts: np.ndarray, classes: int) -> None:
        """The next level, by a row for each active node: gain, feature, cut, class counts of the left side and of the node."""
        nodes, self.active = self.active, []
        for node, row in zip(nodes, cuts):
            left, whole = row[3 : 3 + classes], row[3 + classes :]
            if self.counts[node] is None:
                self.counts[node] = whole
            if not row[0] > 0:
                continue
            self.gain[node], self.feature[node], self.cut[node], self.left[node] = row[0], int(row[1]), int(row[2]), len(self.feature)
            for side in (left, whole - left):
                if np.count_nonzero(side) > 1:
                    self.active.append(len(self.feature))
                for values, value in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.gain, -1.0), (self.counts, side)):
                    values.append(value)

    def rows(self, number: int, edges: list[np.ndarray]) -> Iterator[tuple]:
        for i, counts in enumerate(self.counts):
            inner = self.feature[i] >= 0
            split = (self.feature[i], [float(edges[self.feature[i]][self.cut[i]])], -1) if inner else (-1, [], -1)
            children = (self.left[i], self.left[i] + 1) if inner else (-1, -1)
            facts = i, float(counts.argmax()), float(gini(counts)), counts.tolist(), int(counts.sum()), float(self.gain[i])
            yield number, (*facts, *children, split)


def poisson(share: float) -> np.ndarray:
    """How often a row takes part, by a random number of 16 bits."""
    steps = np.cumsum([math.exp(-share) * share**n / math.factorial(n) for n in range(20)])
    return np.searchsorted(steps, (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


def blocks(rows: DataFrame, edges: list[np.ndarray], classes: int) -> DataFrame:
    """number, bins (by feature), y of blocks of rows with doubles _x0.. and a class _y."""
    width = len(edges)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 33, [], 0

        def emit() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            x = [table.column(i).to_numpy().astype(float) for i in range(width)]
            if any(np.isnan(v).any() for v in x):
                raise ValueError("a feature is missing")
            bins = np.array([np.searchsorted(e, v, side="left") for e, v in zip(edges, x)], np.uint8)
            y = table.column(width).to_numpy().astype(np.uint16)
            data = {"number": pa.array([number], pa.int64()), "bins": pa.array([bins.tobytes()]), "y": pa.array([y.tobytes()])}
            return pa.record_batch(data)

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= BLOCK_ROWS:
                yield emit()
                number, held, size = number + 1, [], 0
        if size:
            yield emit()

    return rows.mapInArrow(cut, "number long, bins binary, y binary")


def level(table: DataFrame, trees: dict[int, Tree], width: int, bins: int, classes: int, chosen: int, share: float, seed: int) -> dict[int, np.ndarray]:
    """The best cuts of the active nodes of some trees (see Tree.grow)."""
    grown = {t: (tree.arrays(), np.array(tree.active)) for t, tree in trees.items()}
    drawn = poisson(share)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {t: np.zeros((width, len(active) * bins * classes)) for t, (_, active) in grown.items()}
        for batch in batches:
            for number, data, labels in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                y = np.frombuffer(labels.as_buffer(), np.uint16).astype(np.intp)
                columns = np.frombuffer(data.as_buffer(), np.uint8).reshape(width, len(y))
                for t, (arrays, active) in grown.items():
                    weights = drawn.take(np.random.default_rng([seed, t, number]).integers(0, 1 << 16, len(y), np.uint16))
                    here = np.flatnonzero(weights)
                    own = columns.take(here, axis=1)
                    place_of = np.full(len(arrays[0]), -1)
                    place_of[active] = np.arange(len(active))
                    place = place_of.take(ends(arrays, own, 0))
                    inside = np.flatnonzero(place >= 0)
                    here, place = here.take(inside), place.take(inside) * (bins * classes)
                    place += y.take(here)
                    weight = weights.take(here).astype(float)
                    for f in range(width):
                        key = own[f].take(inside).astype(np.intp)
                        key *= classes
                        key += place
                        sums[t][f] += np.bincount(key, weight, sums[t].shape[1])
        found = [own.astype(np.uint32).tobytes() for own in sums.values()]
        yield pa.record_batch({"tree": pa.array(list(sums), pa.int32()), "sums": pa.array(found, pa.binary())})

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for t, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.frombuffer(data.as_buffer(), np.uint32)
                if t in sums:
                    sums[t] += own
                else:
                    sums[t] = own.astype(np.int64)
        for t, own in sums.items():
            active = grown[t][1]
            cuts = best_cuts(own.reshape(width, len(active), bins, classes), used_features(active, t, width, chosen, seed))
            yield pa.record_batch({"tree": pa.array([t], pa.int32()), "sums": pa.array([cuts.tobytes()], pa.binary())})

    kind = "tree int, sums binary"
    tasks = min(len(trees), table.rdd.getNumPartitions())
    rows = table.mapInArrow(partial, kind).repartition(tasks, "tree").mapInArrow(combine, kind).collect()  # one row per tree
    return {r["tree"]: np.frombuffer(bytes(r["sums"])).reshape(-1, 3 + 2 * classes) for r in rows}


def used_features(active: np.ndarray, tree: int, width: int, chosen: int, seed: int) -> np.ndarray:
    """Which features (rows) each node may be cut by, drawn by seed, tree and node."""
    return np.array([np.random.default_rng([seed, tree, int(n), 1]).permutation(width) < chosen for n in active]).T


def best_cuts(sums: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Of counts (features, nodes, bins, classes) the best cut of each node by the fall of its impurity (see Tree.grow)."""
    width, nodes, bins, classes = sums.shape
    found = np.empty((nodes, 3 + 2 * classes))
    for i in range(nodes):
        left = np.cumsum(sums[:, i], axis=1)
        whole, left = left[0, -1].astype(float), left[:, :-1].astype(float)
        right, n = whole - left, max(whole.sum(), 1.0)
        nl, nr = left.sum(axis=-1), right.sum(axis=-1)
        gain = gini(whole) - nl / n * gini(left) - nr / n * gini(right)
        gain = np.where((nl > 0) & (nr > 0) & used[:, i, None], gain, -1.0)
        f, cut = divmod(int(gain.argmax()), bins - 1)
        found[i] = [gain[f, cut], f, cut, *left[f, cut], *whole]
    return found


def groups(trees: list[Tree], cells: int) -> Iterator[dict[int, Tree]]:
    """Trees with nodes to cut, as many together as have histograms of GROUP_BYTES."""
    group, size = {}, 0
    for t, tree in enumerate(trees):
        own = len(tree.active) * cells * 8
        if group and size + own > GROUP_BYTES:
            yield group
            group, size = {}, 0
        if tree.active:
            group[t], size = tree, size + own
    if group:
        yield group


def fit(rows: DataFrame, total: int, features: list[str], label: str, classes: int, classifier: RandomForestClassifier) -> RandomForestClassificationModel:
    """The forest that `classifier` describes, over rows with features and a class number below `classes`."""
    bins, seed, strategy = classifier.getMaxBins(), classifier.getSeed(), classifier.getFeatureSubsetStrategy()
    width, share = len(features), classifier.getSubsamplingRate()
    chosen = min(width, math.ceil(math.sqrt(width) if strategy == "auto" else float(strategy) * width))
    edges = bin_edges(rows, features, bins)
    inputs = [F.col(f"`{c}`").cast("double").alias(f"_x{i}") for i, c in enumerate(features)]
    stored = materialize(blocks(rows.select(*inputs, F.col(label).cast("int").alias("_y")), edges, classes), "bins")
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(total / TASK_ROWS))
    table = stored.coalesce(min(tasks, max(1, stored.rdd.getNumPartitions())))
    trees = [Tree() for _ in range(classifier.getNumTrees())]
    for _ in range(classifier.getMaxDepth()):
        for group in groups(trees, width * bins * classes):
            for t, cuts in level(table, group, width, bins, classes, chosen, share, seed).items():
                trees[t].grow(cuts, classes)
    return as_model(rows.sparkSession, classifier, trees, edges, classes)


def as_model(spark: SparkSession, classifier: RandomForestClassifier, trees: list[Tree], edges: list[np.ndarray], classes: int) -> RandomForestClassificationModel:
    """Spark's model of these trees: the nodes of a stored one, fitted to a row per class, are written anew."""
    names = classifier.getFeaturesCol(), classifier.getLabelCol()
    values = array_to_vector(F.array_repeat(F.lit(0.0), len(edges))).alias(names[0])
    start = classifier.fit(spark.range(classes).select(values, F.col("id").cast("double").alias(names[1])))
    path = new_path(spark, "forest")
    start.write().save(path)
    nodes = [row for t, tree in enumerate(trees) for row in tree.rows(t, edges)]
    spark.createDataFrame(nodes, _NODE).write.mode("overwrite").parquet(f"{path}/data")
    return RandomForestClassificationModel.load(path)
