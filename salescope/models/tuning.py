"""Grid search of random forests by nested fits.

A forest holds smaller forests: its first trees are a forest of fewer trees,
and a tree cut below a depth is the tree of that depth (splits are chosen
greedily, from all features).  So for every fold and leaf size one forest is
fitted, with the most trees and the greatest depth, and all points of the grid
are scored from it: a row walks down every tree once, the predictions at the
grid's depths are kept on the way, and the means over the first trees give one
prediction per point.  3 folds x 2 leaf sizes are 6 fits for the 54 of a plain
search over 3 numbers of trees, 3 depths and 2 leaf sizes.

The folds expand in time: the last quarters of the training rows are tested
one after another with all rows before them.  All points of all folds are
scored by one aggregate.  The forests' nodes are read from the saved models
(trees x nodes rows, bounded by the training rows of a fold) and shipped to
the tasks that score.
"""

from __future__ import annotations

import os
import uuid
from concurrent.futures import ThreadPoolExecutor
from itertools import product

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

FOLDS = 3
#: The split-size parameter of the single-machine grid has no Spark counterpart.
GRID = {"numTrees": [100, 200, 300], "maxDepth": [10, 20, 30], "minInstancesPerNode": [1, 2]}


class Forest:
    """Nodes of a fitted forest as arrays [tree, node]; a leaf leads to itself."""

    def __init__(self, nodes: pd.DataFrame):
        nodes = nodes.sort_values(["tree", "id"])
        tree = nodes["tree"].to_numpy()
        at = nodes["id"].to_numpy()
        shape = (int(tree.max()) + 1, int(at.max()) + 1)
        inner = (nodes["left"] >= 0).to_numpy()

        def array(values, fill, dtype):
            out = np.full(shape, fill, dtype=dtype)
            out[tree, at] = values
            return out
        own = np.tile(np.arange(shape[1], dtype=np.int32), (shape[0], 1))
        self.left, self.right = own.copy(), own.copy()
        self.left[tree[inner], at[inner]] = nodes["left"].to_numpy()[inner]
        self.right[tree[inner], at[inner]] = nodes["right"].to_numpy()[inner]
        self.feature = array(np.where(inner, nodes["feature"], 0), 0, np.int32)
        self.threshold = array(np.where(inner, nodes["threshold"], np.inf), np.inf, np.float64)
        self.prediction = array(nodes["prediction"], 0.0, np.float64)

    def predictions(self, x: np.ndarray, trees: list[int], depths: list[int]) -> np.ndarray:
        """[row, trees, depths] means over the first trees, cut at the depths."""
        rows, count = np.arange(len(x)), np.array(trees)
        out = np.empty((len(x), len(trees), len(depths)))
        tree = np.arange(len(self.left))[:, None]
        node = np.zeros((len(self.left), len(x)), dtype=np.int64)
        for depth in range(max(depths) + 1):
            for k in (k for k, d in enumerate(depths) if d == depth):
                total = np.cumsum(self.prediction[tree, node], axis=0)
                out[:, :, k] = (total[count - 1] / count[:, None]).T
            go_left = x[rows[None, :], self.feature[tree, node]] <= self.threshold[tree, node]
            node = np.where(go_left, self.left[tree, node], self.right[tree, node])
        return out


def read_forest(spark, path: str) -> Forest:
    """The nodes of a saved random forest."""
    n = spark.read.parquet(os.path.join(path, "data"))
    node = "nodeData" if "nodeData" in n.columns else None
    c = (lambda x: F.col(f"{node}.{x}")) if node else F.col
    return Forest(n.select(
        F.col("treeID").alias("tree"), c("id").alias("id"), c("prediction").alias("prediction"), c("leftChild").alias("left"),
        c("rightChild").alias("right"), c("split.featureIndex").alias("feature"),
        F.get(c("split.leftCategoriesOrThreshold"), F.lit(0)).alias("threshold")).toPandas())


def folds(n: int) -> list[tuple[int, int]]:
    """(rows to train on, end of the rows to test) of the expanding folds."""
    size = n // (FOLDS + 1)
    return [(n - (FOLDS - i) * size, n - (FOLDS - i - 1) * size) for i in range(FOLDS)]


def _plain(name: str, parameters: dict, compute) -> dict:
    return compute()


def tune(train: DataFrame, fit, grid: dict | None = None, step=_plain, parallelism: int = 8) -> tuple[dict, list[dict]]:
    """(best point, all points with their mean squared error).

    ``train`` has ``_rn`` (1, 2, ... in time), ``features`` and ``revenue``;
    ``fit(rows, **point)`` returns a Spark ML forest.  ``step(name, parameters,
    compute)`` may keep the result of a fold's fit for a later run."""
    grid = grid or GRID
    trees, depths, leaves = grid["numTrees"], grid["maxDepth"], grid["minInstancesPerNode"]
    spark = train.sparkSession
    n = train.count()
    parts = folds(n)

    def score(job: tuple[int, int]) -> dict:
        fold, leaf = job
        end, stop = parts[fold]

        def compute() -> dict:
            model = fit(train.where(F.col("_rn") <= end), numTrees=max(trees), maxDepth=max(depths), minInstancesPerNode=leaf)
            path = scratch_path(spark, f"tuning-{uuid.uuid4().hex}")
            model.write().save(path)
            shipped = spark.sparkContext.broadcast(read_forest(spark, path))

            @F.pandas_udf(T.ArrayType(T.DoubleType()))
            def predict(x: pd.Series) -> pd.Series:
                got = shipped.value.predictions(np.stack(x.to_list()).astype("float64"), trees, depths)
                return pd.Series(list(got.reshape(len(x), -1)))

            tested = train.where((F.col("_rn") > end) & (F.col("_rn") <= stop))
            errors = (tested.select("revenue", F.posexplode(predict(vector_to_array("features"))).alias("point", "p"))
                      .groupBy("point").agg(F.avg((F.col("revenue") - F.col("p")) ** 2).alias("mse")).collect())
            return {str(r["point"]): r["mse"] for r in errors}

        return step(f"fold{fold}-leaf{leaf}", {"grid": grid, "rows": n, "fold": fold, "leaf": leaf}, compute)

    jobs = [(f, leaf) for leaf in leaves for f in reversed(range(FOLDS))]  # long fits first
    with ThreadPoolExecutor(max_workers=min(parallelism, len(jobs))) as pool:
        by_job = dict(zip(jobs, pool.map(score, jobs)))
    points = []
    for t, d, leaf in product(range(len(trees)), range(len(depths)), leaves):
        mse = [by_job[f, leaf][str(t * len(depths) + d)] for f in range(FOLDS)]
        points.append({"numTrees": trees[t], "maxDepth": depths[d], "minInstancesPerNode": leaf, "mse": sum(mse) / FOLDS})
    best = min(range(len(points)), key=lambda i: (points[i]["mse"], i))
    return {k: v for k, v in points[best].items() if k != "mse"}, points
