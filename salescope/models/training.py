"""Training jobs: all models of a table, and their comparison.

``train_all`` fits the tuned forecaster, the product segmenter and the outlier
detector and saves them under one folder.  It is resumable: every finished step
(each fold of the grid search, each saved artefact) leaves an entry in a
manifest beside the artefacts, named by the step and a hash of its parameters
and of the rows trained on.  A run that was stopped continues after the last
finished step; a run with the same rows and parameters returns what is there.
"""

from __future__ import annotations

import hashlib
import json
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import anomaly, forecast, segment

METRICS = ["train_mae", "train_rmse", "train_r2", "train_mape", "test_mae", "test_rmse", "test_r2", "test_mape"]
#: Ensembles are compared on tables of at least so many rows.
ENSEMBLE_ROWS = 200


def fingerprint(df: DataFrame) -> str:
    """A hash of the rows, the same in any order and partitioning."""
    row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
    return f"{row[0]}:{row[1]}"


class Manifest:
    """Finished steps below ``root``, one small JSON text each."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def key(self, name: str, parameters: dict) -> str:
        said = json.dumps(parameters, sort_keys=True, default=str)
        return f"{name}-{hashlib.sha256(said.encode()).hexdigest()[:16]}"

    def _done(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def step(self, name: str, parameters: dict, compute) -> dict:
        """The result of ``compute()``, from the manifest if an earlier run
        finished the step with the same parameters."""
        path = f"{self.root}/manifest/{self.key(name, parameters)}"
        if self._done(path):
            return json.loads(self.spark.read.text(path).first()["value"])
        result = compute()
        self.spark.createDataFrame([(json.dumps(result),)], "value string").coalesce(1).write.mode("overwrite").text(path)
        return result

    def artefact(self, name: str, parameters: dict, build) -> dict:
        """A step that saves something: ``build(path)`` writes it below its own
        path and returns a figure; the entry follows when it is complete."""
        path = f"{self.root}/{self.key(name, parameters)}"
        return self.step(name, parameters, lambda: {"artefact": name, "path": path, "value": build(path)})


def train_all(sales: DataFrame, root: str, model_type: str = "random_forest", tuning: bool = True, grid: dict | None = None,
              k: int = 4, contamination: float = 0.05) -> list[dict]:
    """Fit and save forecaster, segmenter and detector below ``root``; one
    entry (artefact, path, value) each."""
    manifest = Manifest(sales.sparkSession, root)
    rows = fingerprint(sales)

    def kept(name: str, parameters: dict, compute) -> dict:
        return manifest.step(name, parameters | {"data": rows}, compute)

    def forecaster(path: str) -> float:
        fc, _ = forecast.fit_forecaster(sales, model_type, tuning=tuning, grid=grid, step=kept)
        fc.save(path)
        return fc.metrics["test_rmse"]

    def segmenter(path: str) -> float:
        model = segment.fit_segments(segment.product_stats(sales), k=k)
        model.save(path)
        return float(len(model.centres))

    def detector(path: str) -> float:
        model = anomaly.fit_isolation_forest(sales, contamination=contamination)
        model.save(path)
        return model.offset

    return [
        manifest.artefact("forecaster", {"data": rows, "model": model_type, "tuning": tuning, "grid": grid}, forecaster),
        manifest.artefact("segmenter", {"data": rows, "k": k}, segmenter),
        manifest.artefact("detector", {"data": rows, "contamination": contamination}, detector)]


def compare_models(sales: DataFrame, models: list[str] | None = None, test_size: float = 0.2, parallelism: int = 4) -> DataFrame:
    """Every model's metrics, ranked by test RMSE; whatever fails stays as a
    row with its error, after the others.  Fits run as concurrent Spark jobs."""
    if models is None:
        models = ["linear", "ridge", "gradient_boosting", "random_forest", "extra_trees"]
        if sales.limit(ENSEMBLE_ROWS).count() >= ENSEMBLE_ROWS:
            models += ["ensemble", "stacking"]

    def fit(model_type: str) -> tuple:
        try:
            fc, _ = forecast.fit_forecaster(sales, model_type, test_size)
            return (model_type, *[fc.metrics.get(m) for m in METRICS], None)
        except Exception as e:  # a comparison reports what fails, whatever it is
            return (model_type, *[None] * len(METRICS), (str(e).strip() or type(e).__name__).splitlines()[0])

    with ThreadPoolExecutor(max_workers=min(parallelism, len(models))) as pool:
        rows = list(pool.map(fit, models))
    out = sales.sparkSession.createDataFrame(
        rows, "model string, " + ", ".join(f"{m} double" for m in METRICS) + ", error string")
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.col("test_rmse").asc_nulls_last(), F.col("model"))))
