"""Joint quantiles, the report bundle from one aggregate, value maps."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from salescope.operators import bundle, customers, dims, growth, kpi, ordered, profit


@pytest.mark.parametrize("limit,accuracy", [(50_000, 10_000), (20, 10_000), (5, 10)])
def test_joint_quantiles_equal_numpy(spark, monkeypatch, limit, accuracy):
    monkeypatch.setattr(ordered, "LOCAL_RANK_LIMIT", limit)
    monkeypatch.setattr(ordered, "ACCURACY", accuracy)
    rng = random.Random(limit)
    rows = [(rng.gauss(0, 10), float(rng.choice([1, 1, 1, 2, 5])), rng.choice([None, float("nan"), rng.random()]),
             None, i) for i in range(1500)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e int").repartition(4)
    qs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = ordered.joint_quantiles(df, {"a": ("a", qs), "b": ("b", qs), "c": (F.col("c") * 2, [0.5]), "d": ("d", [0.5]), "e": ("e", qs)})
    for k, name in enumerate("abe"):
        values = [r["abcde".index(name)] for r in rows]
        assert np.allclose(got[name], np.quantile(values, qs)), name
    c = [2 * r[2] for r in rows if r[2] is not None and r[2] == r[2]]
    assert got["c"][0] == pytest.approx(np.quantile(c, 0.5)) and got["d"] == [None]


def test_quantile_passes_do_not_grow_with_columns(spark, monkeypatch):
    """Two columns with 6 ranks each take as many jobs as one with two."""
    monkeypatch.setattr(ordered, "LOCAL_RANK_LIMIT", 50)
    df = spark.range(5000).select(F.rand(1).alias("a"), F.rand(2).alias("b")).repartition(2)

    def jobs(wanted):
        calls = []
        agg = type(df).agg
        monkeypatch.setattr(type(df), "agg", lambda self, *a: calls.append(1) or agg(self, *a))
        ordered.joint_quantiles(df, wanted)
        monkeypatch.setattr(type(df), "agg", agg)
        return len(calls)
    assert jobs({"a": ("a", [0.5]), "b": ("b", [0.1, 0.5, 0.9])}) <= jobs({"a": ("a", [0.5])}) + 2


def transactions(spark):
    rng = random.Random(5)
    rows = []
    for i in range(800):
        day = None if i % 97 == 0 else dt.datetime(2023, 1, 1) + dt.timedelta(days=rng.randrange(500), hours=rng.randrange(24))
        rows.append((day, rng.choice(["p1", "p2", "p3", "p4", None]), rng.choice(["c1", "c2", None]), f"u{rng.randrange(30)}",
                     rng.choice(["north", "south"]), rng.choice(["s1", "s2", "s3"]), rng.choice(["web", None]), f"Rep {rng.randrange(4)}",
                     float(rng.randrange(1, 9)), rng.choice([None, round(rng.uniform(1, 100), 2)]), rng.uniform(1, 50)))
    schema = ("date timestamp_ntz, product string, category string, customer string, region string, store string, "
              "channel string, salesperson string, quantity double, revenue double, cost double")
    return spark.createDataFrame(rows, schema).repartition(3)


def same(a, b):
    a, b = (d.select(*sorted(a.columns)).toPandas() for d in (a, b))
    a, b = (d.sort_values(list(d.columns)).reset_index(drop=True) for d in (a, b))
    assert len(a) == len(b) and list(a.columns) == list(b.columns)
    for c in a.columns:
        if a[c].dtype == object or str(a[c].dtype).startswith(("datetime", "str")):
            assert a[c].astype(str).tolist() == b[c].astype(str).tolist(), c
        else:
            assert np.allclose(a[c].astype(float), b[c].astype(float), equal_nan=True), c


def test_bundle_equals_the_single_analyses(spark, tmp_path):
    df = transactions(spark)
    got = bundle.report_bundle(df, str(tmp_path / "cells"))
    want = {
        "kpis": kpi.kpis(df), "monthly_growth": growth.growth_metrics(df), "category_analysis": dims.category_analysis(df),
        "declining_products": growth.declining_products(df), "top_products": dims.top_dimension(df, "product", 30),
        "salesperson_performance": dims.salesperson_performance(df), "regional_analysis": dims.regional_analysis(df),
        "store_analysis": dims.store_analysis(df), "channel_analysis": dims.channel_analysis(df),
        "customer_rfm": customers.rfm_base(df), "profitability": profit.profitability_product(df)}
    assert set(got) == set(want)
    for name in want:
        same(want[name], got[name])


def test_bundle_reads_the_transactions_once(spark, tmp_path):
    df = transactions(spark)
    results = bundle.report_bundle(df, str(tmp_path / "cells"), revenue_source=df.select("revenue"))
    for name, out in results.items():
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "cells" in out.inputFiles()[0] if out.inputFiles() else True
        assert "LogicalRDD" not in plan or name == "kpis", name


def test_bundle_without_some_dimensions(spark, tmp_path):
    df = transactions(spark).drop("channel", "customer", "cost", "quantity")
    got = bundle.report_bundle(df, str(tmp_path / "cells"))
    assert not {"channel_analysis", "customer_rfm", "profitability"} & set(got)
    row = got["kpis"].first()
    assert row["unique_products"] == 4 and "unique_customers" not in row and "total_quantity" not in row


def test_map_values(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("z", 4)], "k string, n int")
    mapping = {"a": "first", "b": "second"}
    table = spark.createDataFrame([("a", "first"), ("b", "second"), (None, "never")], "key string, value string")
    for m in (mapping, table):
        got = {r["n"]: r["g"] for r in dims.map_values(df, "k", m, "g").collect()}
        assert got == {1: "first", 2: "second", 3: None, 4: None}
        got = {r["n"]: r["g"] for r in dims.map_values(df, "k", m, "g", default="other").collect()}
        assert got == {1: "first", 2: "second", 3: "other", 4: "other"}
    assert dims.map_values(df, "k", {}, "g").where("g is null").count() == 4
