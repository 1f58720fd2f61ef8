"""Outlier detection on transactions: z-score and isolation forest.

z-score: one aggregate row (means, sample standard deviations) and a
projection.  Isolation forest (Spark ML has none): the forest is grown from
small per-tree samples and scored over all rows —

1. rows are counted by their model values (one aggregate with map-side
   combine that reads nothing but the model columns), and every copy of a value
   has a draw of its own in every tree.  How many of a value's draws are below
   a limit is binomial in its copies; the hash of the value decides it, so the
   same rows give the same forest in any partitioning.  Most values have none
   and are filtered out by a comparison with that probability.  The limit
   leaves about 2 x ``max_samples`` draws a tree, whatever the size of the
   table or of its hottest value; a tree takes its ``max_samples`` least;
2. trees are grown in ``applyInPandas`` grouped by tree id (those few draws) and come back as node tables (≤ 2 × max_samples rows each);
3. the forest (a few thousand numbers) is shipped to a vectorised pandas UDF
   that scores every row;
4. the decision offset is the exact ``contamination`` quantile of the scores.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordered import exact_quantiles
from ..session import store

DEFAULT_FEATURES = ["revenue", "quantity"]
EULER_GAMMA = 0.5772156649015329


# ---------------------------------------------------------------------------
# z-score
# ---------------------------------------------------------------------------

def zscore(df: DataFrame, cols: list[str] | None = None, threshold: float = 3.0) -> DataFrame:
    """``anomaly`` = any |x − mean| / std > threshold (nulls as 0, sample std);
    ``anomaly_score`` = the largest z.  A column with zero spread is ignored.
    Statistics are recomputed from ``df`` itself (also for new data)."""
    cols = cols or DEFAULT_FEATURES
    x = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols}
    aggs = []
    for c in cols:
        aggs += [F.avg(x[c]).alias(f"m_{c}"), F.stddev_samp(x[c]).alias(f"s_{c}")]
    stats = df.agg(*aggs).first()          # one row
    zs = [F.abs(F.try_divide(x[c] - F.lit(stats[f"m_{c}"]), F.lit(stats[f"s_{c}"]))) for c in cols]
    score = F.greatest(*zs) if len(zs) > 1 else zs[0]
    return df.withColumns({"anomaly": F.coalesce((score > F.lit(threshold)).cast("int"), F.lit(0)),
                           "anomaly_score": score})


# ---------------------------------------------------------------------------
# isolation forest
# ---------------------------------------------------------------------------

def average_path_length(n):
    """Expected path length of an unsuccessful search in a binary search
    tree of ``n`` points (n ≤ 1 → 0, n = 2 → 1)."""
    n = np.asarray(n, dtype="float64")
    out = np.zeros_like(n)
    two = n == 2
    big = n > 2
    out[two] = 1.0
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER_GAMMA) - 2.0 * (n[big] - 1.0) / n[big]
    return out


def _grow(pdf: pd.DataFrame, n_features: int, max_depth: int, seed: int) -> pd.DataFrame:
    """One isolation tree over the sample in ``pdf`` as a node table."""
    tree_id = int(pdf["tree"].iloc[0])
    rng = np.random.default_rng(seed + tree_id)
    x = pdf[[f"x{i}" for i in range(n_features)]].to_numpy(dtype="float64")
    nodes = []   # node, feature, threshold, left, right, size, depth

    def build(idx, depth):
        me = len(nodes)
        nodes.append([me, -1, 0.0, -1, -1, len(idx), depth])
        if depth >= max_depth or len(idx) <= 1:
            return me
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if len(usable) == 0:
            return me
        f = int(rng.choice(usable))
        t = float(rng.uniform(lo[f], hi[f]))
        left = idx[sub[:, f] <= t]
        right = idx[sub[:, f] > t]
        nodes[me][1], nodes[me][2] = f, t
        nodes[me][3] = build(left, depth + 1)
        nodes[me][4] = build(right, depth + 1)
        return me

    build(np.arange(len(x)), 0)
    out = pd.DataFrame(nodes, columns=["node", "feature", "threshold", "left", "right", "size", "depth"])
    out.insert(0, "tree", tree_id)
    return out


def _stacked(forest: list):
    """All trees as [tree, node] arrays; a leaf points to itself, and
    ``leaf_len`` holds depth + c(size) of every leaf, so scoring descends a
    fixed number of levels with no masking."""
    width = max(len(t[0]) for t in forest)
    n_trees = len(forest)
    feat = np.zeros((n_trees, width), dtype="int64")
    thr = np.zeros((n_trees, width))
    left = np.tile(np.arange(width), (n_trees, 1))
    right = left.copy()
    leaf_len = np.zeros((n_trees, width))
    depth_max = 0
    for i, (f, t, lft, rgt, size, depth) in enumerate(forest):
        m = len(f)
        inner = f >= 0
        feat[i, :m] = np.where(inner, f, 0)
        thr[i, :m] = np.where(inner, t, np.inf)          # x <= inf: stay left (= self)
        left[i, :m] = np.where(inner, lft, np.arange(m))
        right[i, :m] = np.where(inner, rgt, np.arange(m))
        leaf_len[i, :m] = depth + average_path_length(size)
        depth_max = max(depth_max, int(depth.max()))
    return feat, thr, left, right, leaf_len, depth_max


def _stacked_width(forest: list) -> int:
    return max(len(t[0]) for t in forest)


def _forest_arrays(nodes: pd.DataFrame) -> list:
    forest = []
    for _, t in nodes.sort_values(["tree", "node"]).groupby("tree"):
        forest.append((t["feature"].to_numpy("int64"), t["threshold"].to_numpy("float64"),
                       t["left"].to_numpy("int64"), t["right"].to_numpy("int64"),
                       t["size"].to_numpy("float64"), t["depth"].to_numpy("float64")))
    return forest


NODE_SCHEMA = ("tree int, node int, feature int, threshold double, left int, right int, "
               "size long, depth int")


class IsolationForestModel:
    def __init__(self, cols, forest, psi, offset, contamination):
        self.cols, self.forest, self.psi = list(cols), forest, psi
        self.offset, self.contamination = offset, contamination

    def score_samples(self, df: DataFrame) -> DataFrame:
        """``_score`` = −2^(−E[h(x)] / c(psi)) (higher = more normal)."""
        forest, psi = self.forest, self.psi
        norm = float(average_path_length([psi])[0]) or 1.0

        feat, thr, left, right, leaf_len, depth_max = (a.ravel() if hasattr(a, "ravel") else a
                                                       for a in _stacked(forest))
        n_trees, width, k = len(forest), _stacked_width(forest), len(self.cols)

        @F.pandas_udf(T.DoubleType())
        def score(*cols: pd.Series) -> pd.Series:
            x = np.column_stack([c.to_numpy(dtype="float64") for c in cols]).ravel()
            n = len(cols[0])
            base = (np.arange(n_trees) * width)[:, None]          # flat offset of every tree
            rows = (np.arange(n) * k)[None, :]
            node = np.broadcast_to(base, (n_trees, n)).copy()     # flat node ids, all at the root
            for _ in range(depth_max):                            # leaves loop onto themselves
                go_left = np.take(x, rows + np.take(feat, node)) <= np.take(thr, node)
                node = base + np.where(go_left, np.take(left, node), np.take(right, node))
            mean_len = np.take(leaf_len, node).mean(axis=0)
            return pd.Series(-np.power(2.0, -mean_len / norm))

        feats = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.cols]
        return df.withColumn("_score", score(*feats))

    def decide(self, scored: DataFrame) -> DataFrame:
        """From ``_score``: ``anomaly`` (1 when the decision value is negative)
        and ``anomaly_score`` = −decision = offset − score."""
        decision = F.col("_score") - F.lit(self.offset)
        return scored.withColumns({"anomaly": (decision < 0).cast("int"),
                                   "anomaly_score": -decision}).drop("_score")

    def transform(self, df: DataFrame) -> DataFrame:
        return self.decide(self.score_samples(df))

    def save(self, path: str) -> None:
        """Node table as Parquet (≤ trees × 2 × max_samples rows) and the
        offset / settings as JSON."""
        import json
        import os
        from pyspark.sql import SparkSession
        spark = SparkSession.getActiveSession()
        recs = []
        for t, (feat, thr, left, right, size, depth) in enumerate(self.forest):
            for i in range(len(feat)):
                recs.append((t, i, int(feat[i]), float(thr[i]), int(left[i]), int(right[i]),
                             int(size[i]), int(depth[i])))
        spark.createDataFrame(recs, NODE_SCHEMA).write.mode("overwrite").parquet(os.path.join(path, "nodes"))
        meta = {"cols": self.cols, "psi": self.psi, "offset": self.offset, "contamination": self.contamination}
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1) \
             .write.mode("overwrite").text(os.path.join(path, "meta"))

    @classmethod
    def load(cls, path: str) -> "IsolationForestModel":
        import json
        import os
        from pyspark.sql import SparkSession
        spark = SparkSession.getActiveSession()
        meta = json.loads(spark.read.text(os.path.join(path, "meta")).first()["value"])
        nodes = spark.read.parquet(os.path.join(path, "nodes")).toPandas()
        return cls(meta["cols"], _forest_arrays(nodes), meta["psi"], meta["offset"], meta["contamination"])


def _copies_below(u: float, slots: int, limit: float, rng: np.random.Generator) -> int:
    """How many of ``slots`` draws are below ``limit``: the binomial quantile
    at ``u``, by summing probabilities where none below is possible at all."""
    if limit >= 1.0:
        return slots
    if slots * limit > 30:
        return int(rng.binomial(slots, limit))
    p = below = math.exp(slots * math.log1p(-limit))
    k = 0
    while below <= u and k < slots and p > 1e-18:
        p *= (slots - k) / (k + 1) * limit / (1.0 - limit)
        below += p
        k += 1
    return k


def _sample(df: DataFrame, cols: list[str], n: int, n_trees: int, psi: int, seed: int) -> DataFrame:
    """(tree, draw, x0, x1, ...): about 2 x psi rows a tree, of which the psi
    of least draw are a uniform sample without replacement."""
    values = [f"x{i}" for i in range(len(cols))]
    rows = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(v) for c, v in zip(cols, values)])
    limit = min(1.0, 2.0 * psi / max(n, 1))
    h = F.xxhash64(F.lit(seed), *values)
    classes = (rows.groupBy(*values).agg(F.count(F.lit(1)).alias("copies"))
               .withColumn("h", h).withColumn("u", F.pmod("h", F.lit(1 << 52)) / F.lit(float(1 << 52))))
    if limit < 1.0:
        none = F.exp(F.col("copies") * F.lit(n_trees * math.log1p(-limit)))
        classes = classes.where(F.col("u") >= none)
    schema = "tree int, draw double, " + ", ".join(f"{v} double" for v in values)

    def draw(frames):
        for pdf in frames:
            at, tree, place = [], [], []
            for i, (m, h, u) in enumerate(zip(pdf["copies"], pdf["h"], pdf["u"])):
                rng = np.random.Generator(np.random.Philox(key=int(h) & ((1 << 64) - 1)))
                slots = int(m) * n_trees
                k = _copies_below(float(u), slots, limit, rng)
                at.append(np.full(k, i))
                tree.append(rng.choice(slots, size=k, replace=False, shuffle=False) % n_trees)
                place.append(rng.random(k) * limit)
            if at:
                out = pdf[values].iloc[np.concatenate(at)].reset_index(drop=True)
                out.insert(0, "draw", np.concatenate(place))
                out.insert(0, "tree", np.concatenate(tree).astype("int32"))
                yield out

    return classes.mapInPandas(draw, schema)


def fit_isolation_forest(df: DataFrame, cols: list[str] | None = None, n_trees: int = 100,
                         max_samples: int = 256, contamination: float = 0.05, seed: int = 42,
                         return_scored: bool = False, stored: bool = False):
    """``stored`` tells that ``df`` comes straight from a written table."""
    cols = cols or DEFAULT_FEATURES
    k = len(cols)
    # counting, sampling and scoring read rows that are written once; a plain
    # fit reads only the model's columns
    if not stored:
        df = store(df if return_scored else df.select(*cols))
    n = df.count()
    psi = int(min(max_samples, n))
    max_depth = int(math.ceil(math.log2(max(psi, 2))))
    sample = _sample(df, cols, n, n_trees, psi, seed)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        least = pdf.sort_values(["draw", *[f"x{i}" for i in range(k)]]).head(psi)
        return _grow(least, k, max_depth, seed)

    nodes = sample.groupBy("tree").applyInPandas(grow, NODE_SCHEMA).toPandas()  # ≤ n_trees × 2 psi rows
    forest = _forest_arrays(nodes)
    model = IsolationForestModel(cols, forest, psi, 0.0, contamination)
    # flagging the fitted rows too: the scored table is written once below the
    # checkpoint folder and read twice (threshold, flags) — no second scoring
    # pass, nothing held in memory.  A plain fit keeps only the score column
    # for the length of the quantile rounds.
    scored = model.score_samples(df)
    if return_scored:
        scored = store(scored)
    (offset,) = exact_quantiles(scored, "_score", [contamination])
    model.offset = float(offset)
    return (model, scored) if return_scored else model


def isolation_forest(df: DataFrame, cols: list[str] | None = None, contamination: float = 0.05,
                     seed: int = 42) -> DataFrame:
    """Fit on ``df`` and flag its rows; every row is scored once."""
    model, scored = fit_isolation_forest(df, cols, contamination=contamination, seed=seed, return_scored=True)
    return model.decide(scored)


def anomaly_summary(scored: DataFrame) -> DataFrame:
    """Rows, anomalies and the anomaly rate %."""
    return scored.agg(F.count(F.lit(1)).alias("rows"), F.sum("anomaly").alias("anomalies")) \
                 .withColumn("anomaly_rate_pct", F.try_divide(F.col("anomalies") * 100.0, F.col("rows")))


def anomalies_only(scored: DataFrame) -> DataFrame:
    """The flagged rows, highest score first."""
    return scored.where(F.col("anomaly") == 1).orderBy(F.col("anomaly_score").desc())
