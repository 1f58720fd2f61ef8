"""Daily revenue forecasting on Spark ML.

Training data is the daily feature table (one row per observed day and
series — bounded by the calendar, not by the transactions; the transaction →
day aggregation is the distributed, data-sized step).  Features are scaled
with the median / inter-quartile range of the training rows (exact
percentiles over the bounded table), assembled into a vector and fitted with
a Spark ML regressor, or from one Gram-matrix aggregate (``linear``).

The recursive multi-day forecast is a loop of Spark jobs over all series at
once: every series carries its last 30 daily values as an array column, the
next day's features are built from that array with built-in higher-order
functions, the model scores the day, and the prediction is appended to the
array.  The state is checkpointed every few steps to cut the lineage.
"""

from __future__ import annotations

import json
import os
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import (GBTRegressionModel, GBTRegressor, RandomForestRegressionModel,
                                   RandomForestRegressor)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.features import DAILY_FEATURES, calendar_columns, daily_features
from ..session import ensure_checkpoint_dir
from . import linear, tuning as grid_search

MODEL_TYPES = ["linear", "ridge", "lasso", "random_forest", "extra_trees", "gradient_boosting",
               "xgboost", "lightgbm", "ensemble", "stacking"]
HISTORY = 30          # daily values carried per series by the recursive forecast
EPS = 2.220446049250313e-16   # machine epsilon: MAPE denominator floor

# Tree training: node ids are cached between levels and up to 1 GB of node
# statistics is aggregated per pass (fully grown trees need few passes).
TREE_OPTS = dict(maxBins=32, cacheNodeIds=True, maxMemoryInMB=1024)


# ---------------------------------------------------------------------------
# split, scaling
# ---------------------------------------------------------------------------

def split_train_test(daily: DataFrame, test_size: float = 0.2, series: list[str] | None = None) -> DataFrame:
    """Ordered split: the first floor(n × (1 − test_size)) days of each series
    are 'train', the rest 'test'; ``_rn`` is the 1-based day index."""
    keys = list(series or [])
    w = Window.partitionBy(*keys).orderBy("date")
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    out = daily.withColumn("_rn", F.row_number().over(w))
    cut = F.floor(n * F.lit(1.0 - test_size))
    return out.withColumn("split", F.when(F.col("_rn") <= cut, F.lit("train")).otherwise(F.lit("test")))


def fit_scaler(train: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """{column: (median, IQR)} with IQR 0 replaced by 1 — exact linear
    percentiles in one aggregate over the bounded daily table."""
    aggs = [F.percentile(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), [0.25, 0.5, 0.75]).alias(c) for c in cols]
    row = train.agg(*aggs).first()
    out = {}
    for c in cols:
        q25, q50, q75 = row[c]
        iqr = q75 - q25
        out[c] = (float(q50), float(iqr) if iqr != 0 else 1.0)
    return out


def apply_scaler(df: DataFrame, stats: dict[str, tuple[float, float]], cols: list[str]) -> DataFrame:
    """Scaled copies ``<col>__s`` and the assembled ``features`` vector."""
    scaled = {f"{c}__s": (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.lit(stats[c][0])) / F.lit(stats[c][1])
              for c in cols}
    out = df.withColumns(scaled)
    return VectorAssembler(inputCols=[f"{c}__s" for c in cols], outputCol="features").transform(out) \
        .drop(*scaled.keys())


# ---------------------------------------------------------------------------
# estimators
# ---------------------------------------------------------------------------

def _estimator(model_type: str, **params):
    if model_type == "random_forest":
        p = dict(numTrees=200, minInstancesPerNode=2, maxDepth=30)
        p.update(params)
        return RandomForestRegressor(featureSubsetStrategy="all", seed=42, **TREE_OPTS, **p)
    if model_type == "gradient_boosting":
        p = dict(maxIter=200, stepSize=0.05, maxDepth=5, subsamplingRate=0.8)
        p.update(params)
        return GBTRegressor(seed=42, **TREE_OPTS, **p)
    if model_type in ("xgboost", "lightgbm"):
        # the libraries are not part of the cluster image: the documented
        # fallback is gradient boosting with 200 rounds at learning rate 0.05
        return GBTRegressor(maxIter=200, stepSize=0.05, maxDepth=3, seed=42, **TREE_OPTS)
    if model_type == "extra_trees":
        raise ValueError("extra_trees has no Spark ML counterpart")
    raise ValueError(f"unknown model type {model_type}; choose from {MODEL_TYPES}")


class _Averaged:
    """Mean of the predictions of several fitted models (voting ensemble)."""

    def __init__(self, models):
        self.models = models

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for i, m in enumerate(self.models):
            out = m.transform(out).withColumnRenamed("prediction", f"_p{i}")
        mean = sum(F.col(f"_p{i}") for i in range(len(self.models))) / F.lit(float(len(self.models)))
        return out.withColumn("prediction", mean).drop(*[f"_p{i}" for i in range(len(self.models))])


class _Stacked:
    """Base models + a ridge on their predictions."""

    def __init__(self, bases, final):
        self.bases, self.final = bases, final

    def transform(self, df: DataFrame) -> DataFrame:
        out = df.withColumnRenamed("features", "_x")
        for i, m in enumerate(self.bases):
            out = m.transform(out.withColumnRenamed("_x", "features")).withColumnRenamed("features", "_x") \
                   .withColumnRenamed("prediction", f"_b{i}")
        names = [f"_b{i}" for i in range(len(self.bases))]
        out = VectorAssembler(inputCols=names, outputCol="features").transform(out)
        return self.final.transform(out).drop("features", *names).withColumnRenamed("_x", "features")


def _fit_one(model_type: str, train: DataFrame, **params):
    if model_type in linear.KINDS:
        return linear.fit_linear(train, model_type, **params)
    return _estimator(model_type, **params).setLabelCol("revenue").setFeaturesCol("features").fit(train)


def _fit_model(model_type: str, train: DataFrame, tuning: bool = False, grid: dict | None = None, step=None):
    if model_type == "ensemble":
        members = [("random_forest", dict(minInstancesPerNode=1)),
                   ("gradient_boosting", dict(maxDepth=3, subsamplingRate=1.0))]
        return _Averaged(_fit_concurrently([(mt, train, p) for mt, p in members]))
    if model_type == "stacking":
        return _fit_stacking(train)
    if tuning and model_type == "random_forest":
        best, _ = tune_random_forest(train, grid, step)
        model = _fit_one("random_forest", train, **best)
        model._salescope_best = best
        return model
    return _fit_one(model_type, train)


def _fit_stacking(train: DataFrame):
    """Out-of-fold predictions of the base models on 3 contiguous folds feed
    a ridge; the base models are then refitted on all training rows."""
    n = train.count()
    fold = F.least(F.floor((F.col("_rn") - 1) * F.lit(3) / F.lit(n)), F.lit(2)).cast("int")
    t = train.withColumn("_fold", fold)
    bases = [("random_forest", dict(numTrees=100, minInstancesPerNode=1)),
             ("gradient_boosting", dict(maxIter=100, stepSize=0.1, maxDepth=3, subsamplingRate=1.0))]
    # the 3 × 2 fold fits and the 2 full fits are independent: concurrent jobs
    jobs = [(mt, t.where(F.col("_fold") != k), p) for k in range(3) for mt, p in bases]
    jobs += [(mt, train, p) for mt, p in bases]
    fitted = _fit_concurrently(jobs)
    oof = None
    for k in range(3):
        part = t.where(F.col("_fold") == k).select("_rn", "revenue", "features")
        for i in range(len(bases)):
            part = fitted[k * len(bases) + i].transform(part).withColumnRenamed("prediction", f"_b{i}")
        part = part.drop("features")
        oof = part if oof is None else oof.unionByName(part)
    meta = VectorAssembler(inputCols=[f"_b{i}" for i in range(len(bases))], outputCol="features").transform(oof)
    final = _fit_one("ridge", meta)
    return _Stacked(fitted[-len(bases):], final)


def _fit_concurrently(jobs: list, parallelism: int = 8) -> list:
    """Fit independent models as concurrent Spark jobs (what CrossValidator's
    ``parallelism`` does); results keep the order of ``jobs``."""
    with ThreadPoolExecutor(max_workers=min(parallelism, len(jobs))) as pool:
        return list(pool.map(lambda j: _fit_one(j[0], j[1], **j[2]), jobs))


def tune_random_forest(train: DataFrame, grid: dict | None = None, step=None) -> tuple[dict, list[dict]]:
    """Grid search over expanding time folds by nested fits (``tuning``)."""
    return grid_search.tune(train, lambda rows, **p: _fit_one("random_forest", rows, **p), grid,
                            *([step] if step else []))


# ---------------------------------------------------------------------------
# the fitted forecaster
# ---------------------------------------------------------------------------

class Forecaster:
    """Fitted daily forecaster: scaler statistics + Spark ML model(s)."""

    def __init__(self, model_type: str, stats: dict, model, metrics: dict | None = None,
                 series: list[str] | None = None):
        self.model_type, self.stats, self.model = model_type, stats, model
        self.metrics = metrics or {}
        self.series = list(series or [])
        self.feature_columns = list(DAILY_FEATURES)

    def transform(self, df: DataFrame) -> DataFrame:
        """Predict for rows holding the daily feature columns (missing → 0)."""
        x = df
        for c in self.feature_columns:
            if c not in x.columns:
                x = x.withColumn(c, F.lit(0.0))
        out = self.model.transform(apply_scaler(x, self.stats, self.feature_columns))
        return out.drop("features")

    def feature_importance(self) -> DataFrame:
        spark = _active()
        imp = getattr(self.model, "featureImportances", None)
        if imp is None:
            return spark.createDataFrame([("Model does not support feature importance", 0.0)],
                                         "feature string, importance double")
        rows = sorted(((c, float(imp[i])) for i, c in enumerate(self.feature_columns)), key=lambda r: (-r[1], r[0]))
        return spark.createDataFrame(rows, "feature string, importance double")

    def save(self, path: str) -> None:
        """Spark ML model folders plus a JSON of the scaler and metadata."""
        spark = _active()
        meta = {"model_type": self.model_type, "stats": self.stats, "metrics": self.metrics,
                "series": self.series, "features": self.feature_columns}
        parts = _parts(self.model)
        meta["parts"] = [[kind, i] for i, (kind, _) in enumerate(parts)]
        for i, (kind, m) in enumerate(parts):
            at = os.path.join(path, f"part{i}")
            m.save(at) if kind == "linear" else m.write().overwrite().save(at)
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1) \
             .write.mode("overwrite").text(os.path.join(path, "meta"))

    @classmethod
    def load(cls, path: str) -> "Forecaster":
        spark = _active()
        meta = json.loads(spark.read.text(os.path.join(path, "meta")).first()["value"])
        loaded = [_LOADERS[kind].load(os.path.join(path, f"part{i}")) for kind, i in meta["parts"]]
        mt = meta["model_type"]
        if mt == "ensemble":
            model = _Averaged(loaded)
        elif mt == "stacking":
            model = _Stacked(loaded[:-1], loaded[-1])
        else:
            model = loaded[0]
        stats = {k: tuple(v) for k, v in meta["stats"].items()}
        return cls(mt, stats, model, meta.get("metrics"), meta.get("series"))


_LOADERS = {"linear": linear.LinearFit, "rf": RandomForestRegressionModel, "gbt": GBTRegressionModel}


def _kind(m) -> str:
    if isinstance(m, linear.LinearFit):
        return "linear"
    if isinstance(m, RandomForestRegressionModel):
        return "rf"
    return "gbt"


def _parts(model):
    if isinstance(model, _Averaged):
        return [(_kind(m), m) for m in model.models]
    if isinstance(model, _Stacked):
        return [(_kind(m), m) for m in model.bases] + [(_kind(model.final), model.final)]
    return [(_kind(model), model)]


def _active():
    from pyspark.sql import SparkSession
    return SparkSession.getActiveSession()


def regression_metrics(pred: DataFrame, label: str = "revenue", prediction: str = "prediction",
                       by: str | None = None) -> DataFrame:
    """MAE, RMSE, R² and MAPE % (denominator floored at machine epsilon)."""
    y, p = F.col(label), F.col(prediction)
    err = y - p
    aggs = [F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
            F.sum(err * err).alias("_ss_res"), (F.var_pop(y) * F.count(y)).alias("_ss_tot"),
            (F.avg(F.abs(err) / F.greatest(F.abs(y), F.lit(EPS))) * 100).alias("mape")]
    g = pred.groupBy(by) if by else pred
    out = g.agg(*aggs)
    r2 = (F.when(F.col("_ss_tot") != 0, 1 - F.col("_ss_res") / F.col("_ss_tot"))
           .when(F.col("_ss_res") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return out.withColumn("r2", r2).drop("_ss_res", "_ss_tot")


def fit_forecaster(sales: DataFrame, model_type: str = "random_forest", test_size: float = 0.2,
                   tuning: bool = False, series: list[str] | None = None, grid: dict | None = None,
                   step=None) -> tuple[Forecaster, DataFrame]:
    """Build the daily feature table, split by time, scale on train, fit,
    and report train/test metrics.  Returns (forecaster, scored rows)."""
    daily = daily_features(sales, series)
    # one row per day and series, read by every pass of the fits
    ensure_checkpoint_dir(daily.sparkSession)
    split = split_train_test(daily, test_size, series).checkpoint(eager=True)
    stats = fit_scaler(split.where(F.col("split") == "train"), DAILY_FEATURES)
    data = apply_scaler(split, stats, DAILY_FEATURES)
    train = data.where(F.col("split") == "train")
    model = _fit_model(model_type, train, tuning, grid, step)
    scored = model.transform(data).drop("features")
    m = regression_metrics(scored, by="split").collect()
    metrics = {f"{r['split']}_{k}": float(r[k]) for r in m for k in ("mae", "rmse", "r2", "mape")}
    return Forecaster(model_type, stats, model, metrics, series), scored


def metrics_frame(fc: Forecaster) -> DataFrame:
    keys = ["train_mae", "train_rmse", "train_r2", "train_mape", "test_mae", "test_rmse", "test_r2", "test_mape"]
    return _active().createDataFrame([tuple(fc.metrics.get(k) for k in keys)], ", ".join(f"{k} double" for k in keys))


# ---------------------------------------------------------------------------
# recursive forecast
# ---------------------------------------------------------------------------

def _window_exprs(h: str = "_hist") -> dict:
    """Lag / rolling / slope features of the next day from the history array."""
    n = f"size({h})"

    def lag(k):
        return F.expr(f"IF({n} >= {k}, element_at({h}, {n} - {k} + 1), aggregate({h}, 0D, (a, x) -> a + x) / {n})")

    def last(k):
        return f"slice({h}, greatest({n} - {k - 1}, 1), {k})"

    def mean(k):
        return F.expr(f"aggregate({last(k)}, 0D, (a, x) -> a + x) / size({last(k)})")

    w7 = last(7)
    m = f"size({w7})"
    mean7 = f"(aggregate({w7}, 0D, (a, x) -> a + x) / {m})"
    pop_std = F.expr(f"IF({m} > 1, sqrt(aggregate({w7}, 0D, (a, x) -> a + (x - {mean7}) * (x - {mean7})) / {m}), 0D)")
    sx = f"({m} * ({m} - 1) / 2.0)"
    sxx = f"(({m} - 1) * {m} * (2 * {m} - 1) / 6.0)"
    sy = f"aggregate({w7}, 0D, (a, x) -> a + x)"
    sxy = f"aggregate(zip_with({w7}, sequence(0, {m} - 1), (y, i) -> y * i), 0D, (a, v) -> a + v)"
    slope = F.expr(f"IF({m} >= 2, ({m} * {sxy} - {sx} * {sy}) / ({m} * {sxx} - {sx} * {sx}), 0D)")
    return {"lag_1": lag(1), "lag_7": lag(7), "lag_14": lag(14), "lag_30": lag(30),
            "rolling_7": mean(7), "rolling_14": mean(14), "rolling_30": mean(30),
            "rolling_std7": pop_std, "trend_7": slope}


def forecast_future(fc: Forecaster, sales: DataFrame, periods: int = 30, checkpoint_every: int = 10) -> DataFrame:
    """Recursive ``periods``-day forecast per series; each prediction (clipped
    at 0) becomes the next day's lag.  History is the training day table."""
    keys = fc.series
    daily = daily_features(sales, keys).select(*keys, "date", "revenue")
    w = Window.partitionBy(*keys).orderBy(F.col("date").desc())
    recent = daily.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= HISTORY)
    g = recent.groupBy(*keys) if keys else recent.groupBy()
    state = g.agg(F.max("date").alias("_last"),
                  F.transform(F.array_sort(F.collect_list(F.struct("date", "revenue"))),
                              lambda s: s["revenue"]).alias("_hist"))
    state = state.withColumn("_out", F.array().cast("array<struct<date:timestamp_ntz,forecast:double>>"))
    feats = _window_exprs()
    for i in range(periods):
        nxt = F.date_add(F.col("_last"), i + 1).cast("timestamp_ntz")
        step = state.withColumn("date", nxt).withColumns(calendar_columns(F.col("date"))).withColumns(feats)
        scored = fc.transform(step)
        pred = F.greatest(F.col("prediction"), F.lit(0.0))
        state = scored.select(
            *keys, "_last",
            F.expr(f"slice(concat(_hist, array(greatest(prediction, 0D))), "
                   f"-least(size(_hist) + 1, {HISTORY}), least(size(_hist) + 1, {HISTORY}))").alias("_hist"),
            F.concat(F.col("_out"), F.array(F.struct(F.col("date"), pred.alias("forecast")))).alias("_out"))
        if checkpoint_every and (i + 1) % checkpoint_every == 0 and i + 1 < periods:
            state = state.checkpoint(eager=True)
    out = state.select(*keys, F.explode("_out").alias("_o"))
    return out.select(*keys, F.col("_o.date").alias("date"), F.col("_o.forecast").alias("forecast"))
