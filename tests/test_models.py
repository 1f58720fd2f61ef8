"""Model invariants and numerical parity where it is attainable."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from salescope.models import anomaly, forecast, linear, segment, training, tuning
from salescope.operators.features import DAILY_FEATURES, daily_features
from salescope.sources.tables import sales_view


@pytest.fixture(scope="module")
def sales(spark, sf_dir):
    return sales_view(spark, sf_dir, ["date", "product", "region", "revenue", "quantity", "price"]).cache()


@pytest.fixture(scope="module")
def linear_fit(sales):
    return forecast.fit_forecaster(sales, "linear")


def test_split_is_ordered_80_20(sales):
    s = forecast.split_train_test(daily_features(sales)).toPandas().sort_values("date")
    n = len(s)
    assert (s["split"] == "train").sum() == int(n * 0.8)
    assert s["split"].iloc[: int(n * 0.8)].eq("train").all()


def test_linear_equals_least_squares(sales, linear_fit):
    fc, scored = linear_fit
    pdf = scored.where(F.col("split") == "train").toPandas()
    daily = forecast.split_train_test(daily_features(sales)).where(F.col("split") == "train").toPandas()
    x = np.column_stack([(daily[c].fillna(0) - fc.stats[c][0]) / fc.stats[c][1] for c in DAILY_FEATURES])
    x = np.column_stack([np.ones(len(x)), x])
    beta, *_ = np.linalg.lstsq(x, daily["revenue"].to_numpy(), rcond=None)
    pred = x @ beta
    got = pdf.sort_values("date")["prediction"].to_numpy()
    assert np.allclose(np.sort(got), np.sort(pred), rtol=1e-6, atol=1e-3)


def test_metrics_keys(linear_fit):
    fc, _ = linear_fit
    assert set(fc.metrics) == {f"{s}_{m}" for s in ("train", "test") for m in ("mae", "rmse", "r2", "mape")}


def test_future_is_non_negative_and_complete(sales, linear_fit):
    fc, _ = linear_fit
    out = forecast.forecast_future(fc, sales, 12, checkpoint_every=5).toPandas()
    assert len(out) == 12 and (out["forecast"] >= 0).all()
    assert out["date"].is_monotonic_increasing and out["date"].diff().dropna().dt.days.eq(1).all()


def test_short_history_uses_mean_for_missing_lags(spark):
    import datetime as dt
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(days=i), float(100 + i)) for i in range(12)]
    sales = spark.createDataFrame(rows, "date timestamp_ntz, revenue double")
    fc, _ = forecast.fit_forecaster(sales, "linear", test_size=0.25)
    out = forecast.forecast_future(fc, sales, 3).toPandas()
    assert len(out) == 3 and out["forecast"].notna().all()


def test_save_and_load_give_same_predictions(spark, sales, linear_fit, tmp_path):
    fc, scored = linear_fit
    path = str(tmp_path / "fc")
    fc.save(path)
    again = forecast.Forecaster.load(path)
    a = fc.transform(daily_features(sales)).select("date", "prediction").toPandas().sort_values("date")
    b = again.transform(daily_features(sales)).select("date", "prediction").toPandas().sort_values("date")
    assert np.allclose(a["prediction"], b["prediction"])


def test_segments_at_most_k_and_named(sales):
    stats = segment.product_stats(sales)
    model = segment.fit_segments(stats, k=4, n_init=2)
    out = segment.assign_segments(model, stats).toPandas()
    assert out["cluster"].nunique() <= 4
    assert set(out["segment"]) <= {"Star Products", "Premium Products", "Volume Products", "Low Performers"}


def test_zscore_constant_column_ignored(spark):
    df = spark.createDataFrame([(float(x), 5.0) for x in [1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 100]],
                               "revenue double, quantity double")
    out = anomaly.zscore(df).toPandas()
    assert out["anomaly"].sum() == 1 and out["anomaly_score"].notna().all()


def test_isolation_forest_flags_contamination_share(sales):
    out = anomaly.isolation_forest(sales, contamination=0.05).toPandas()
    share = out["anomaly"].mean()
    assert 0.03 <= share <= 0.07
    again = anomaly.isolation_forest(sales, contamination=0.05).toPandas()
    assert np.allclose(np.sort(out["anomaly_score"]), np.sort(again["anomaly_score"]))


def test_isolation_forest_save_load(sales, tmp_path):
    model = anomaly.fit_isolation_forest(sales, contamination=0.05)
    path = str(tmp_path / "det")
    model.save(path)
    again = anomaly.IsolationForestModel.load(path)
    a = model.transform(sales).select("anomaly_score").toPandas()["anomaly_score"].to_numpy()
    b = again.transform(sales).select("anomaly_score").toPandas()["anomaly_score"].to_numpy()
    assert np.allclose(np.sort(a), np.sort(b))


def test_forest_scores_match_plain_traversal(sales):
    model = anomaly.fit_isolation_forest(sales, contamination=0.05)
    pdf = model.score_samples(sales.limit(40)).toPandas()
    norm = anomaly.average_path_length([model.psi])[0]
    for _, r in pdf.iterrows():
        x = [r["revenue"], r["quantity"]]
        total = 0.0
        for feat, thr, left, right, size, depth in model.forest:
            node = 0
            while feat[node] >= 0:
                node = left[node] if x[feat[node]] <= thr[node] else right[node]
            total += depth[node] + anomaly.average_path_length([size[node]])[0]
        expected = -2.0 ** (-(total / len(model.forest)) / norm)
        assert r["_score"] == pytest.approx(expected, rel=1e-12)


# -- linear models from the Gram matrix ----------------------------------------

@pytest.fixture(scope="module")
def scaled(sales):
    split = forecast.split_train_test(daily_features(sales)).where(F.col("split") == "train").checkpoint()
    return forecast.apply_scaler(split, forecast.fit_scaler(split, DAILY_FEATURES), DAILY_FEATURES).select("_rn", "revenue", "features")


@pytest.mark.parametrize("kind", linear.KINDS)
def test_gram_fits_equal_spark_ml(scaled, kind):
    from pyspark.ml.regression import LinearRegression
    n, sd = scaled.agg(F.count("*"), F.stddev_samp("revenue")).first()
    settings = {"linear": dict(regParam=0.0, solver="normal"),
                "ridge": dict(regParam=sd / n, elasticNetParam=0.0, solver="l-bfgs", maxIter=1000, tol=1e-12),
                "lasso": dict(regParam=1.0, elasticNetParam=1.0, maxIter=10000, tol=1e-12)}[kind]
    theirs = LinearRegression(labelCol="revenue", standardization=False, **settings).fit(scaled)
    ours = linear.fit_linear(scaled, kind)
    a = theirs.transform(scaled).orderBy("_rn").toPandas()["prediction"]
    b = ours.transform(scaled).orderBy("_rn").toPandas()["prediction"]
    assert np.allclose(a, b, rtol=1e-5)


def test_linear_systems():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 4))
    y = x @ [1.0, -2.0, 0.0, 3.0] + rng.normal(size=50) * 0.1
    assert np.allclose(linear.solve(x.T @ x, x.T @ y), np.linalg.lstsq(x, y, rcond=None)[0])
    twice = np.c_[x, x[:, 0]]  # dependent features: the least norm shares the coefficient
    b = linear.solve(twice.T @ twice, twice.T @ y)
    assert np.allclose(twice @ b, x @ np.linalg.lstsq(x, y, rcond=None)[0]) and b[0] == pytest.approx(b[4])
    lasso = linear.coordinate_descent(x.T @ x / 50, x.T @ y / 50, 0.5)
    slope = x.T @ (y - x @ lasso) / 50  # at the optimum: penalty where active, less elsewhere
    assert np.allclose(slope[lasso != 0], 0.5 * np.sign(lasso[lasso != 0])) and (np.abs(slope) <= 0.5 + 1e-9).all()
    assert (linear.coordinate_descent(np.eye(2), np.array([0.1, -0.1]), 0.5) == 0).all()


# -- tuning, training ----------------------------------------------------------

SMALL_GRID = {"numTrees": [3, 8], "maxDepth": [1, 4], "minInstancesPerNode": [1, 40]}


def _forest(rows, **p):
    return forecast._fit_one("random_forest", rows, **p)


def test_a_forest_holds_the_smaller_ones(spark, scaled, tmp_path):
    model = _forest(scaled, numTrees=4, maxDepth=5, minInstancesPerNode=2)
    model.write().save(str(tmp_path / "rf"))
    nodes = tuning.read_forest(spark, str(tmp_path / "rf"))
    pdf = scaled.limit(60).toPandas()
    x = np.stack([v.toArray() for v in pdf["features"]])
    got = nodes.predictions(x, [1, 4], [0, 2, 5])
    rows = spark.createDataFrame(pdf)
    assert np.allclose(got[:, 1, 2], model.transform(rows).toPandas()["prediction"])
    assert np.allclose(got[:, 0, 2], [model.trees[0].predict(v) for v in pdf["features"]])
    # the same draws with a smaller depth give the tree cut at that depth
    cut = _forest(scaled, numTrees=4, maxDepth=2, minInstancesPerNode=2)
    assert np.allclose(got[:, 1, 1], cut.transform(rows).toPandas()["prediction"])
    assert len(np.unique(got[:, 0, 0])) == 1


def test_tuning_picks_the_point_of_direct_fits(scaled):
    n = scaled.count()
    fits = []
    best, points = tuning.tune(scaled, lambda rows, **p: fits.append(p) or _forest(rows, **p), SMALL_GRID)
    assert len(fits) == 6 and len(points) == 8
    direct = {}
    for p in points:
        errors = []
        for end, stop in tuning.folds(n):
            m = _forest(scaled.where(F.col("_rn") <= end), **{k: v for k, v in p.items() if k != "mse"})
            tested = m.transform(scaled.where((F.col("_rn") > end) & (F.col("_rn") <= stop)))
            errors.append(tested.agg(F.avg((F.col("revenue") - F.col("prediction")) ** 2)).first()[0])
        direct[p["numTrees"], p["maxDepth"], p["minInstancesPerNode"]] = sum(errors) / 3
    # points with the most trees are the direct fits; fewer trees are other draws of the same kind
    for p in points:
        want = direct[p["numTrees"], p["maxDepth"], p["minInstancesPerNode"]]
        assert p["mse"] == pytest.approx(want, rel=1e-9 if p["numTrees"] == 8 else 0.5)
    full = {k: v for k, v in direct.items() if k[0] == 8}
    best_full = min((p for p in points if p["numTrees"] == 8), key=lambda p: p["mse"])
    assert (8, best_full["maxDepth"], best_full["minInstancesPerNode"]) == min(full, key=full.get)
    assert best["mse" if "mse" in best else "numTrees"] and min(p["mse"] for p in points) == next(
        p["mse"] for p in points if all(p[k] == v for k, v in best.items()))


def test_folds_expand_in_time():
    assert tuning.folds(100) == [(25, 50), (50, 75), (75, 100)]
    assert tuning.folds(103) == [(28, 53), (53, 78), (78, 103)]


def test_stopped_training_goes_on(spark, sales, tmp_path, monkeypatch):
    root, grid = str(tmp_path / "models"), {"numTrees": [2, 3], "maxDepth": [2], "minInstancesPerNode": [1]}
    fits = []
    fit_one = forecast._fit_one
    monkeypatch.setattr(forecast, "_fit_one", lambda *a, **p: fits.append(p) or fit_one(*a, **p))

    def stop(*a, **k):
        raise RuntimeError("stopped")
    with monkeypatch.context() as m:
        m.setattr(segment, "fit_segments", stop)
        with pytest.raises(RuntimeError):
            training.train_all(sales, root, grid=grid)
    assert len(fits) == 4  # three folds and the chosen forest
    rows = training.train_all(sales, root, grid=grid)
    assert len(fits) == 4 and [r["artefact"] for r in rows] == ["forecaster", "segmenter", "detector"]
    assert training.train_all(sales.repartition(3), root, grid=grid) == rows  # nothing is fitted again
    again = forecast.Forecaster.load(rows[0]["path"])
    assert again.metrics["test_rmse"] == pytest.approx(rows[0]["value"])
    # a fold that was finished before the stop is not fitted again either
    with monkeypatch.context() as m:
        m.setattr(forecast.Forecaster, "save", stop)
        with pytest.raises(RuntimeError):
            training.train_all(sales, root + "2", grid=grid)
    before = len(fits)
    with monkeypatch.context() as m:
        m.setattr(segment, "fit_segments", stop)
        with pytest.raises(RuntimeError):
            training.train_all(sales, root + "2", grid=grid)
    assert len(fits) == before + 1
    # other rows are another training
    other = training.Manifest(spark, root).key("forecaster", {"data": training.fingerprint(sales.limit(10))})
    assert other != training.Manifest(spark, root).key("forecaster", {"data": training.fingerprint(sales)})


def test_comparison_survives_any_failure(sales, monkeypatch):
    fit = forecast.fit_forecaster

    def broken(df, model_type, *a, **k):
        if model_type == "ridge":
            raise KeyError("lost")
        return fit(df, model_type, *a, **k)
    monkeypatch.setattr(forecast, "fit_forecaster", broken)
    rows = training.compare_models(sales, ["linear", "ridge", "extra_trees"]).orderBy("rank").collect()
    assert [r["model"] for r in rows] == ["linear", "extra_trees", "ridge"]
    assert rows[0]["error"] is None and "lost" in rows[2]["error"] and rows[1]["test_rmse"] is None


# -- the forest's sample -------------------------------------------------------

def test_sample_gives_every_copy_its_own_draw(spark):
    n, trees, psi = 20_000, 100, 256
    df = spark.range(n).select(F.when(F.col("id") % 2 == 0, 7.0).otherwise(F.col("id").cast("double")).alias("revenue"),
                               (F.col("id") % 5).cast("double").alias("quantity"))
    draws = [anomaly._sample(df.repartition(p), ["revenue", "quantity"], n, trees, psi, 42).toPandas() for p in (1, 7)]
    a, b = (d.sort_values(list(d.columns)).reset_index(drop=True) for d in draws)
    assert a.equals(b)  # the same in any partitioning
    sizes = a.groupby("tree").size()
    assert len(sizes) == trees and sizes.min() >= psi and sizes.max() < 3 * psi
    least = a.sort_values("draw").groupby("tree").head(psi)
    assert (least.groupby("tree").size() == psi).all()
    # a value that half of the rows hold has half of each sample, not all or none
    share = least.assign(hot=least["x0"] == 7.0).groupby("tree")["hot"].mean()
    assert abs(share.mean() - 0.5) < 0.01 and share.min() > 0.3 and share.max() < 0.7
    # single rows are drawn about equally often, and not twice by one tree
    single = least[least["x0"] != 7.0]
    assert not single.duplicated(["tree", "x0"]).any()
    assert abs(len(single) / (n / 2) - trees * psi / n) < 0.1


def test_small_tables_are_taken_whole(spark):
    df = spark.createDataFrame([(1.0, 2.0)] * 3 + [(float(i), 0.0) for i in range(40)], "revenue double, quantity double")
    sample = anomaly._sample(df, ["revenue", "quantity"], 43, 5, 43, 1).toPandas()
    assert (sample.groupby("tree").size() == 43).all() and (sample[sample["x1"] == 2.0].groupby("tree").size() == 3).all()
    out = anomaly.isolation_forest(df).toPandas()
    assert len(out) == 43 and out["anomaly_score"].notna().all()


def test_copies_below_follow_the_binomial():
    u = (np.arange(4000) + 0.5) / 4000
    rng = np.random.default_rng(0)
    counts = np.array([anomaly._copies_below(float(x), 50, 0.02, rng) for x in u])
    assert counts.mean() == pytest.approx(1.0, rel=0.01) and counts.var() == pytest.approx(0.98, rel=0.02)
    assert (np.diff(counts) >= 0).all() and counts[0] == 0
    assert anomaly._copies_below(0.3, 9, 1.0, rng) == 9
    many = [anomaly._copies_below(0.5, 100_000, 0.01, rng) for _ in range(200)]
    assert np.mean(many) == pytest.approx(1000, rel=0.02)


# -- segments ------------------------------------------------------------------

def _blobs(spark, n=120):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(4, 6)) * 40
    rows = [(f"p{i}", *(centres[i % 4] + rng.normal(size=6) * 3).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "product string, " + ", ".join(f"{c} double" for c in segment.SEGMENT_FEATURES))


def test_kmeans_finds_the_groups_in_any_partitioning(spark):
    stats = _blobs(spark)
    models = [segment.fit_segments(stats.repartition(p)) for p in (1, 6)]
    assert np.allclose(models[0].centres, models[1].centres)
    got = models[0].transform(segment._filled(stats)).select("product", "cluster").toPandas()
    group = got["product"].str[1:].astype(int) % 4
    assert got.groupby(group)["cluster"].nunique().eq(1).all() and got["cluster"].nunique() == 4
    assert [c[0] for c in models[0].centres] == sorted((c[0] for c in models[0].centres), reverse=True)


def test_kmeans_is_as_good_as_spark_ml(spark, sales):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector
    stats = segment.product_stats(sales)
    model = segment.fit_segments(stats)
    points = model.transform(segment._filled(stats)).withColumn("features", array_to_vector(model.scaled()))
    theirs = min(KMeans(k=4, seed=s).fit(points.drop("prediction")).summary.trainingCost for s in range(5))
    assert model.cost <= theirs * 1.02
    # every centre is the mean of its cluster, every point is with its nearest centre
    pdf = points.select("cluster", model.scaled().alias("x")).toPandas()
    x, c = np.stack(pdf["x"]), np.array(model.centres)
    d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    assert (d.argmin(axis=1) == pdf["cluster"]).all() and d.min(axis=1).sum() == pytest.approx(model.cost)
    assert np.allclose(c, [x[pdf["cluster"] == k].mean(axis=0) for k in range(len(c))], atol=1e-6)
    want = ClusteringEvaluator(featuresCol="features", predictionCol="cluster").evaluate(points)
    assert segment.silhouette(model, stats) == pytest.approx(want)


def test_segments_of_few_or_equal_products(spark):
    schema = "product string, " + ", ".join(f"{c} double" for c in segment.SEGMENT_FEATURES)
    two = spark.createDataFrame([("a", *[1.0] * 6), ("b", *[2.0] * 5, None), ("c", *[1.0] * 6)], schema)
    model = segment.fit_segments(two)
    assert len(model.centres) == 2 and model.cost == pytest.approx(0.0)
    assert segment.silhouette(model, two) == pytest.approx(2 / 3)  # b is alone: 0
    same = spark.createDataFrame([("a", *[1.0] * 6), ("b", *[1.0] * 6)], schema)
    assert len(segment.fit_segments(same).centres) == 1 and segment.silhouette(segment.fit_segments(same), same) is None
    with pytest.raises(ValueError):
        segment.fit_segments(two.limit(0))


def test_segments_save_load(spark, tmp_path):
    stats = _blobs(spark, 40)
    model = segment.fit_segments(stats, k=3, n_init=2)
    model.save(str(tmp_path / "seg"))
    again = segment.SegmentModel.load(str(tmp_path / "seg"))
    a, b = (segment.assign_segments(m, stats).orderBy("product").collect() for m in (model, again))
    assert a == b
