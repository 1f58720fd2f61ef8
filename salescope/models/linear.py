"""Linear, ridge and lasso regression from one aggregate.

Everything the three need of the rows is their Gram matrix: one pass sums the
products of features and label (a row of (p + 1)(p + 4) / 2 numbers, combined
inside the tasks), and the driver solves a system of p unknowns.  The cost on
the cluster is that of one aggregate whatever the solver does.

* ``linear``: least squares by Cholesky; features that depend on each other
  get the solution of least norm.
* ``ridge``: ``|y - Xb|^2 + alpha |b|^2``, the intercept free.
* ``lasso``: ``|y - Xb|^2 / 2n + alpha |b|_1`` by coordinate descent.

Features should be centred roughly (the forecaster's are, by their medians):
sums of squares far from zero lose digits.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("linear", "ridge", "lasso")


def gram(df: DataFrame, features: str = "features", label: str = "revenue", size: int | None = None):
    """(n, mean of the features, mean of the label, centred X'X, centred X'y);
    rows with a null label are left out."""
    rows = df.where(F.col(label).isNotNull()).select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"))
    p = size if size is not None else len(rows.first()["x"])
    at = lambda i: F.get("x", F.lit(i))
    sums = [F.count(F.lit(1)).alias("n"), F.sum("y").alias("y")]
    sums += [F.sum(at(i)).alias(f"x{i}") for i in range(p)]
    sums += [F.sum(at(i) * F.col("y")).alias(f"x{i}y") for i in range(p)]
    sums += [F.sum(at(i) * at(j)).alias(f"x{i}x{j}") for i in range(p) for j in range(i, p)]
    row = rows.agg(*sums).first()
    n = row["n"]
    if not n:
        raise ValueError("no rows to fit")
    mean = np.array([row[f"x{i}"] for i in range(p)]) / n
    y = row["y"] / n
    xx = np.empty((p, p))
    for i in range(p):
        for j in range(i, p):
            xx[i, j] = xx[j, i] = row[f"x{i}x{j}"] - n * mean[i] * mean[j]
    xy = np.array([row[f"x{i}y"] for i in range(p)]) - n * mean * y
    return n, mean, y, xx, xy


def solve(xx: np.ndarray, xy: np.ndarray) -> np.ndarray:
    """Symmetric positive semidefinite system."""
    scale = np.sqrt(np.where(np.diag(xx) > 0, np.diag(xx), 1.0))
    a, b = xx / np.outer(scale, scale), xy / scale
    try:
        low = np.linalg.cholesky(a)
        if np.diag(low).min(initial=1.0) > 1e-7:
            return np.linalg.solve(low.T, np.linalg.solve(low, b)) / scale
    except np.linalg.LinAlgError:
        pass
    return np.linalg.lstsq(a, b, rcond=1e-12)[0] / scale


def coordinate_descent(xx: np.ndarray, xy: np.ndarray, penalty: float, rounds: int = 100_000, tol: float = 1e-13) -> np.ndarray:
    """Least of ``b'XXb / 2 - XY'b + penalty |b|_1``."""
    b = np.zeros(len(xy))
    rest = xy.copy()  # xy - xx b
    for _ in range(rounds):
        moved = 0.0
        for j in np.flatnonzero(np.diag(xx) > 0):
            z = rest[j] + xx[j, j] * b[j]
            new = np.sign(z) * max(abs(z) - penalty, 0.0) / xx[j, j]
            if new != b[j]:
                rest -= xx[:, j] * (new - b[j])
                moved = max(moved, abs(new - b[j]) * np.sqrt(xx[j, j]))
                b[j] = new
        if moved <= tol * max(np.sqrt(np.abs(xy).max(initial=0.0)), 1.0):
            break
    return b


class LinearFit:
    """Coefficients and intercept; scores a vector column inside the JVM."""

    def __init__(self, kind: str, coefficients, intercept: float):
        self.kind = kind
        self.coefficients, self.intercept = [float(c) for c in coefficients], float(intercept)

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        terms = F.zip_with(vector_to_array(features), F.array(*[F.lit(c) for c in self.coefficients]), lambda x, c: x * c)
        return df.withColumn("prediction", F.aggregate(terms, F.lit(self.intercept), lambda a, x: a + x))

    def save(self, path: str) -> None:
        from pyspark.sql import SparkSession
        spark = SparkSession.getActiveSession()
        state = {"kind": self.kind, "coefficients": self.coefficients, "intercept": self.intercept}
        spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, path: str) -> "LinearFit":
        from pyspark.sql import SparkSession
        state = json.loads(SparkSession.getActiveSession().read.text(path).first()["value"])
        return cls(state["kind"], state["coefficients"], state["intercept"])


def fit_linear(df: DataFrame, kind: str = "linear", alpha: float = 1.0, features: str = "features",
               label: str = "revenue") -> LinearFit:
    n, mean, y, xx, xy = gram(df, features, label)
    if kind == "linear":
        b = solve(xx, xy)
    elif kind == "ridge":
        b = solve(xx + alpha * np.eye(len(xy)), xy)
    elif kind == "lasso":
        b = coordinate_descent(xx / n, xy / n, alpha)
    else:
        raise ValueError(f"unknown kind {kind}; choose from {KINDS}")
    return LinearFit(kind, b, y - float(mean @ b))
