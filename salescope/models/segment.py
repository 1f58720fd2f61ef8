"""Product segmentation: per-product statistics, k-means on standardised
features, cluster names from cluster profiles."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..session import ensure_checkpoint_dir

SEGMENT_FEATURES = ["total_revenue", "avg_revenue", "transaction_count",
                    "total_quantity", "avg_quantity", "avg_price"]


def product_stats(df: DataFrame) -> DataFrame:
    """revenue sum/mean/count, quantity sum/mean, mean price per product."""
    return (df.where(F.col("product").isNotNull()).groupBy("product")
              .agg(F.coalesce(F.sum("revenue"), F.lit(0.0)).alias("total_revenue"),
                   F.avg("revenue").alias("avg_revenue"),
                   F.count("revenue").alias("transaction_count"),
                   F.coalesce(F.sum("quantity"), F.lit(0.0)).alias("total_quantity"),
                   F.avg("quantity").alias("avg_quantity"),
                   F.avg("price").alias("avg_price")))


# ---------------------------------------------------------------------------
# k-means segmentation
# ---------------------------------------------------------------------------

MAX_ITERATIONS = 60
#: Centres that move less have come to rest.
TOLERANCE = 1e-9


def _filled(stats: DataFrame) -> DataFrame:
    return stats.withColumns({f"{c}__f": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in SEGMENT_FEATURES})


def _literal(values) -> Column:
    """Nested lists of numbers as one literal."""
    return F.array(*[_literal(v) for v in values]) if isinstance(values, list) else F.lit(float(values))


def _nearest(x: Column, centres: Column) -> Column:
    """Struct (d, i): squared Euclidean distance and index of the nearest of an
    array of centres; ties to the lower index."""
    def distance(c: Column) -> Column:
        return F.aggregate(F.zip_with(x, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)
    return F.array_min(F.transform(centres, lambda c, i: F.struct(distance(c).alias("d"), i.alias("i"))))


class SegmentModel:
    """Scaling of the features and the cluster centres (scaled, the cluster of
    largest revenue first)."""

    def __init__(self, mean: list[float], std: list[float], centres: list[list[float]], cost: float):
        self.mean, self.std, self.centres, self.cost = mean, std, centres, cost

    def scaled(self) -> Column:
        return F.array(*[(F.col(f"{c}__f") - F.lit(m)) / F.lit(s) for c, m, s in zip(SEGMENT_FEATURES, self.mean, self.std)])

    def transform(self, filled: DataFrame) -> DataFrame:
        """``cluster`` of every row of ``_filled`` statistics."""
        return filled.withColumn("cluster", _nearest(self.scaled(), _literal(self.centres))["i"])

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        state = {"mean": self.mean, "std": self.std, "centres": self.centres, "cost": self.cost}
        spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, path: str) -> "SegmentModel":
        state = json.loads(SparkSession.getActiveSession().read.text(path).first()["value"])
        return cls(state["mean"], state["std"], state["centres"], state["cost"])


def _uniform(seed: int, start: Column, pick: int) -> Column:
    """A number in (0, 1) that depends on the draw and the product alone."""
    key = F.concat(F.lit(f"{seed}:"), start.cast("string"), F.lit(f":{pick}:"), F.col("product"))
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + 0.5) / float(16 ** 13)


def _first_centres(points: DataFrame, k: int, n_init: int, seed: int) -> list[list[list[float]]]:
    """Centres of every start by k-means++: each pick is a draw with weights of
    the squared distance to the centres so far, as a race of exponential
    variables (the least of -ln(u) / weight wins), so a pick of all starts is
    one aggregate."""
    chosen: list[list] = [[] for _ in range(n_init)]
    for pick in range(k):
        weights = F.transform(_literal(chosen), lambda c: _nearest(F.col("x"), c)["d"]) if pick else _literal([1.0] * n_init)
        race = points.select("product", "x", F.posexplode(weights).alias("start", "weight")).where("weight > 0")
        won = race.groupBy("start").agg(F.min(F.struct((-F.log(_uniform(seed, F.col("start"), pick)) / F.col("weight")).alias("r"),
                                                       "product", "x")).alias("w")).collect()
        for r in won:  # a start without a row has all products as centres already
            chosen[r["start"]].append(list(r["w"]["x"]))
    return chosen


def fit_segments(stats: DataFrame, k: int = 4, n_init: int = 10, seed: int = 42) -> SegmentModel:
    """Standardise the six product features and run k-means from ``n_init``
    starts; keep the one of lowest within-cluster cost.

    All starts run together: an iteration is one aggregate keyed by start and
    cluster, so the passes over the products do not grow with the starts, and
    what comes back is ``n_init`` x ``k`` rows.  Draws are keyed by the product:
    the same products give the same segments in any partitioning."""
    ensure_checkpoint_dir(stats.sparkSession)
    filled = _filled(stats).select("product", *[f"{c}__f" for c in SEGMENT_FEATURES]).checkpoint(eager=True)
    moments = filled.agg(*[f(f"{c}__f").alias(f"{n}{i}") for i, c in enumerate(SEGMENT_FEATURES)
                           for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if moments["m0"] is None:
        raise ValueError("no products to segment")
    dims = range(len(SEGMENT_FEATURES))
    model = SegmentModel([moments[f"m{i}"] for i in dims], [moments[f"s{i}"] or 1.0 for i in dims], [], 0.0)
    points = filled.select("product", model.scaled().alias("x")).checkpoint(eager=True)  # read by every pass
    centres = _first_centres(points, k, n_init, seed)
    moving = list(range(n_init))
    for _ in range(MAX_ITERATIONS):
        at = F.transform(_literal([centres[s] for s in moving]), lambda c: _nearest(F.col("x"), c)["i"])
        means = (points.select("x", F.posexplode(at).alias("start", "cluster")).groupBy("start", "cluster")
                 .agg(*[F.avg(F.col("x")[i]).alias(f"x{i}") for i in dims]).collect())
        shift = dict.fromkeys(moving, 0.0)
        for r in means:  # a cluster without products keeps its centre
            s, new = moving[r["start"]], [r[f"x{i}"] for i in dims]
            shift[s] = max(shift[s], max(abs(a - b) for a, b in zip(new, centres[s][r["cluster"]])))
            centres[s][r["cluster"]] = new
        moving = [s for s in moving if shift[s] > TOLERANCE]
        if not moving:
            break
    cost = F.transform(_literal(centres), lambda c: _nearest(F.col("x"), c)["d"])
    costs = {r["start"]: r["cost"] for r in points.select(F.posexplode(cost).alias("start", "d"))
             .groupBy("start").agg(F.sum("d").alias("cost")).collect()}
    best = min(costs, key=lambda s: (costs[s], s))
    model.centres, model.cost = sorted(centres[best], reverse=True), costs[best]
    return model


def cluster_profiles(assigned: DataFrame) -> DataFrame:
    """Mean of each feature per cluster (one row per cluster: k rows)."""
    return assigned.groupBy("cluster").agg(*[F.avg(F.col(f"{c}__f")).alias(c) for c in SEGMENT_FEATURES])


def segment_names(profiles: DataFrame) -> DataFrame:
    """Star (revenue and frequency above the profile medians), Premium
    (revenue only), Volume (frequency only), Low Performers."""
    med = profiles.agg(*[F.percentile(c, 0.5).alias(c) for c in
                         ["total_revenue", "transaction_count", "avg_price"]]).first()
    hi_rev = F.col("total_revenue") > F.lit(med["total_revenue"])
    hi_freq = F.col("transaction_count") > F.lit(med["transaction_count"])
    name = (F.when(hi_rev & hi_freq, F.lit(fixed.SEGMENT_STAR))
             .when(hi_rev, F.lit(fixed.SEGMENT_PREMIUM))
             .when(hi_freq, F.lit(fixed.SEGMENT_VOLUME))
             .otherwise(F.lit(fixed.SEGMENT_LOW)))
    return profiles.withColumn("segment", name)


def assign_segments(model: SegmentModel, stats: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Assign clusters and attach segment names (the name table has one row
    per cluster, a bound of k rows)."""
    assigned = model.transform(_filled(stats))
    if names is None:
        names = segment_names(cluster_profiles(assigned))
    out = assigned.join(F.broadcast(names.select("cluster", "segment")), "cluster", "left")
    return out.drop(*[f"{c}__f" for c in SEGMENT_FEATURES])


def segment_products(df: DataFrame, k: int = 4) -> tuple[SegmentModel, DataFrame]:
    stats = product_stats(df)
    model = fit_segments(stats, k)
    return model, assign_segments(model, stats)


def silhouette(model: SegmentModel, stats: DataFrame) -> float | None:
    """Mean silhouette (squared Euclidean) when 2 <= clusters < products.

    The mean distance of a point to a cluster follows from the cluster's size,
    vector sum and sum of squared norms, so two aggregates do: one row per
    cluster, then the mean over the points."""
    points = model.transform(_filled(stats)).select("cluster", model.scaled().alias("x"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda p, q: p + q)
    points = points.withColumn("norm", dot(F.col("x"), F.col("x")))
    rows = points.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("norm").alias("q"), *[
        F.sum(F.col("x")[i]).alias(f"y{i}") for i in range(len(SEGMENT_FEATURES))]).collect()
    if not 2 <= len(rows) <= sum(r["n"] for r in rows) - 1:
        return None
    clusters = F.array(*[F.struct(F.lit(r["cluster"]).alias("c"), F.lit(float(r["n"])).alias("n"), F.lit(r["q"]).alias("q"),
                                  _literal([r[f"y{i}"] for i in range(len(SEGMENT_FEATURES))]).alias("y")) for r in rows])

    def mean(c: Column, n: Column) -> Column:  # of the squared distances to a cluster's points
        return F.try_divide(F.col("norm") * c["n"] + c["q"] - 2 * dot(F.col("x"), c["y"]), n)
    own = F.filter(clusters, lambda c: c["c"] == F.col("cluster"))[0]
    a = mean(own, own["n"] - 1)
    b = F.array_min(F.transform(F.filter(clusters, lambda c: c["c"] != F.col("cluster")), lambda c: mean(c, c["n"])))
    points = points.select(a.alias("a"), b.alias("b"))
    s = F.when(F.col("a").isNotNull(), F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")))
    return points.agg(F.avg(F.coalesce(s, F.lit(0.0)))).first()[0]  # alone in its cluster: 0


def segment_summary(segments: DataFrame) -> DataFrame:
    """Products and revenue per segment."""
    return segments.groupBy("segment").agg(F.count(F.lit(1)).alias("products"),
                                           F.sum("total_revenue").alias("total_revenue"))
