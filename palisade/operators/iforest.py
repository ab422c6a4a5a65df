"""Isolation forest (Liu, Ting, Zhou 2008) as Spark jobs.

Fitting moves only the subsamples: a seeded row hash decides which tree a row joins, so about trees x 256 rows are
shuffled whatever the size of the table, and every tree is grown from its own small group. Scoring ships the node
table (trees x at most 511 nodes) with the tasks and walks it in Arrow batches.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.functions import columns as C
from palisade.operators import prep
from palisade.operators.quantiles import exact_quantiles
from palisade.session import materialize

TREES, SAMPLE, CONTAMINATION, SEED = 100, 256, 0.02, 42
_NODE = "tree int, node int, feature int, cut double, left int, right int, length double, rows int"
_OVERSAMPLE = 1.5
_STEPS = (37, 41)  # primes: one of them shares no factor with any usual number of trees


def average_path(n):
    """Mean path length of an unsuccessful search in a binary search tree of n rows."""
    n = np.asarray(n, dtype=float)
    big = 2.0 * (np.log(np.maximum(n, 2) - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / np.maximum(n, 1)
    return np.where(n > 2, big, np.where(n == 2, 1.0, 0.0))


def _subsamples(
    df: DataFrame, total: int, key: list[str], columns: list[str], trees: int, sample: int, seed: int
) -> DataFrame:
    """Rows (tree, rank, x): for every tree somewhat more than `sample` of the `total` rows, drawn by hash."""
    share = min(1.0, _OVERSAMPLE * sample / max(total, 1))  # chance of a row to be offered to one tree
    offers = share * trees
    h = F.xxhash64(*key, F.lit(seed))
    u = F.pmod(h, F.lit(1 << 30)) / float(1 << 30)
    k = F.lit(math.floor(offers)) + (u < offers - math.floor(offers)).cast("int")
    first = F.pmod(F.xxhash64(*key, F.lit(seed + 1)), F.lit(trees))
    chosen = df.withColumn("_k", k).filter("_k > 0").withColumn("_first", first)
    step = next(s for s in _STEPS if trees % s)  # repeated memberships of a row go to different trees
    spread = F.transform(
        F.sequence(F.lit(0), F.col("_k") - 1), lambda j: ((F.col("_first") + j * step) % trees).cast("int")
    )
    return chosen.select(
        F.explode(spread).alias("tree"),
        F.xxhash64(*key, F.lit(seed + 2)).alias("rank"),
        F.array(*[F.col(f"`{c}`").cast("double") for c in columns]).alias("x"),
    )


def _grow(sample: int, seed: int):
    def build(rows: pd.DataFrame) -> pd.DataFrame:
        tree = int(rows["tree"].iloc[0])
        # another order for each tree, so that a tree does not favour the rows it shares with its neighbours
        order = pd.util.hash_array((rows["rank"].to_numpy() ^ np.int64(tree * 0x9E3779B1)).astype(np.int64))
        x = np.stack(rows["x"].to_numpy()[np.argsort(order, kind="stable")])[:sample]
        rng = np.random.default_rng([seed, tree])
        deepest = max(1, math.ceil(math.log2(max(len(x), 2))))
        nodes: list[list] = []
        todo = [(np.arange(len(x)), 0, None, None)]
        while todo:
            members, depth, parent, side = todo.pop()
            number = len(nodes)
            if parent is not None:
                nodes[parent][side] = number
            part = x[members]
            low, high = part.min(axis=0), part.max(axis=0)
            usable = np.flatnonzero(high > low)
            if depth >= deepest or len(usable) == 0:
                nodes.append([tree, number, -1, 0.0, -1, -1, depth + float(average_path(len(members))), len(members)])
                continue
            f = int(rng.choice(usable))
            cut = float(rng.uniform(low[f], high[f]))
            nodes.append([tree, number, f, cut, -1, -1, 0.0, len(members)])
            goes_left = part[:, f] <= cut
            todo.append((members[~goes_left], depth + 1, number, 5))
            todo.append((members[goes_left], depth + 1, number, 4))
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "cut", "left", "right", "length", "rows"])

    return build


def grow_forest(
    df: DataFrame,
    total: int,
    key: list[str],
    columns: list[str],
    trees: int = TREES,
    sample: int = SAMPLE,
    seed: int = SEED,
) -> DataFrame:
    """The node table of a forest over `total` complete rows."""
    drawn = _subsamples(df, total, key, columns, trees, sample, seed)
    return drawn.groupBy("tree").applyInPandas(_grow(sample, seed), _NODE)


class Forest:
    """Fitted medians, scaler, node table and threshold; all of them small and saved as tables."""

    def __init__(self, columns, medians, scaler, nodes: DataFrame, sample: int, threshold: float | None = None):
        self.columns, self.medians, self.scaler = list(columns), medians, scaler
        self.nodes, self.sample, self.threshold = nodes, sample, threshold

    def score(self, df: DataFrame, medians: dict | None = None) -> DataFrame:
        """Add anomaly_score (lower is more anomalous) and, with a threshold, anomaly_prediction (-1 or 1)."""
        model = self.nodes.orderBy("tree", "node").toPandas()
        walk = _scorer(model, self.sample)
        # the scaled features live in one array column, so the rows keep their own values
        values = []
        for c in self.columns:
            clean = C.clean_to_null(F.col(f"`{c}`").cast("double"))
            m, s = self.scaler[c]
            fill = (medians or self.medians)[c]
            values.append((F.coalesce(clean, F.lit(fill)) - F.lit(m)) / F.lit(s))
        scored = df.withColumn("anomaly_score", walk(F.array(*values)))
        if self.threshold is None:
            return scored
        return scored.withColumn("anomaly_prediction", F.when(F.col("anomaly_score") < self.threshold, -1).otherwise(1))

    def save(self, path: str) -> None:
        spark = self.nodes.sparkSession
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        rows = [
            (i, c, self.medians[c], self.scaler[c][0], self.scaler[c][1], self.sample, self.threshold)
            for i, c in enumerate(self.columns)
        ]
        schema = "place int, feature string, median double, mean double, std double, sample int, threshold double"
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/features")

    @classmethod
    def load(cls, spark, path: str) -> "Forest":
        rows = spark.read.parquet(f"{path}/features").orderBy("place").collect()
        return cls(
            [r["feature"] for r in rows],
            {r["feature"]: r["median"] for r in rows},
            {r["feature"]: (r["mean"], r["std"]) for r in rows},
            spark.read.parquet(f"{path}/nodes"),
            rows[0]["sample"],
            rows[0]["threshold"],
        )


def _scorer(model: pd.DataFrame, sample: int):
    """Pandas UDF with the node table as flat arrays; every tree is walked for the whole batch at once."""
    starts = model.groupby("tree")["node"].size().cumsum().shift(fill_value=0).to_numpy()
    base = np.repeat(starts, model.groupby("tree")["node"].size().to_numpy())
    feature = model["feature"].to_numpy()
    cut = model["cut"].to_numpy()
    left = np.where(feature >= 0, model["left"].to_numpy() + base, -1)
    right = np.where(feature >= 0, model["right"].to_numpy() + base, -1)
    length = model["length"].to_numpy()
    norm = float(average_path(sample))

    @F.pandas_udf("double")
    def score(values: pd.Series) -> pd.Series:
        if len(values) == 0:
            return pd.Series([], dtype=float)
        x = np.stack(values.to_numpy()).astype(float)
        paths = np.zeros(len(x))
        everyone = np.arange(len(x))
        for start in starts:
            at = np.full(len(x), start)
            active = everyone
            while len(active):
                here = at[active]
                inner = feature[here] >= 0
                active, here = active[inner], here[inner]
                goes_left = x[active, feature[here]] <= cut[here]
                at[active] = np.where(goes_left, left[here], right[here])
            paths += length[at]
        return pd.Series(-np.exp2(-(paths / len(starts)) / norm))

    return score


def fit(
    df: DataFrame,
    key: list[str],
    columns: list[str],
    contamination: float = CONTAMINATION,
    trees: int = TREES,
    sample: int = SAMPLE,
    seed: int = SEED,
) -> Forest:
    """Clean, fill, scale, grow, and set the threshold at the `contamination` quantile of the training scores."""
    # the training matrix is read several times: written once, whatever made the rows is not run again
    clean = materialize(prep.infinite_to_null(df.select(*key, *columns), columns), "training")
    medians = prep.medians(clean, columns)
    filled = prep.impute(clean, medians)
    total = clean.count()
    scaler = prep.scaler(filled, columns)
    nodes = materialize(grow_forest(prep.scale(filled, scaler), total, key, columns, trees, sample, seed), "forest")
    forest = Forest(columns, medians, scaler, nodes, min(sample, total))
    scores = materialize(forest.score(filled.select(*columns)).select("anomaly_score"), "scores")
    forest.threshold = exact_quantiles(scores, ["anomaly_score"], contamination)["anomaly_score"]
    return forest
