"""Hand-written edge fixtures with hand-computed answers."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from salescope.functions import scalar
from salescope.operators import conform, customers, dims, growth, kpi, ordered, profit
from salescope.operators.features import price_tier_expr

D = dt.datetime


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


# ---------------------------------------------------------------------------
# headers
# ---------------------------------------------------------------------------

def test_header_mapping_exact_and_partial():
    m = conform.header_mapping(["Tanggal", "Nama Toko", "Nama Pelanggan", "Sales Name", "Nama Barang Jual",
                                "Qty", "Harga Satuan", "HPP", "Grand Total", "Status Order"])
    assert m["tanggal"] == "date"
    assert m["nama_toko"] == "store"
    assert m["nama_pelanggan"] == "customer"
    assert m["sales_name"] == "salesperson"
    assert m["nama_barang_jual"] == "product"          # substring match
    assert m["qty"] == "quantity"
    assert m["harga_satuan"] == "price"                # first price-like header wins
    assert "hpp" not in m                              # stays a cost column
    assert m["grand_total"] == "revenue"
    assert m["status_order"] == "status"


def test_reserved_header_never_becomes_product():
    m = conform.header_mapping(["kurir", "nilai"])
    assert "kurir" not in m or m["kurir"] == "courier"
    assert m.get("nilai") == "revenue"


def test_product_column_with_statuses_is_dropped(spark):
    df = spark.createDataFrame([("Selesai", "A", 1.0), ("Dikirim", "B", 2.0), ("Selesai", "A", 3.0)],
                               "nama_produk string, kategori string, grand_total double")
    out = conform.standardize_columns(df)
    assert "product" in out.columns
    assert sorted(rows(out, "product")) == [("A",), ("A",), ("B",)]   # proxied from category


def test_no_product_no_category_uses_channel_and_general(spark):
    df = spark.createDataFrame([("Shopee", "Toko 1", 1.0)], "channel string, nama_toko string, revenue double")
    out = conform.standardize_columns(df)
    r = out.first()
    assert r["product"] == "Shopee" and r["category"] == "Shopee" and r["region"] == "Toko 1"


# ---------------------------------------------------------------------------
# dates
# ---------------------------------------------------------------------------

@pytest.mark.parametrize("text,expected", [
    (["2024-03-05", "2024-12-31"], [D(2024, 3, 5), D(2024, 12, 31)]),
    (["05/03/2024", "31/12/2024"], [D(2024, 3, 5), D(2024, 12, 31)]),
    (["03/05/2024", "12/31/2024"], [D(2024, 3, 5), D(2024, 12, 31)]),     # day > 12 → month first
    (["20240305", "20241231"], [D(2024, 3, 5), D(2024, 12, 31)]),
    (["March 05, 2024", "December 31, 2024"], [D(2024, 3, 5), D(2024, 12, 31)]),
    (["5 Mar 2024", "31 Dec 2024"], [D(2024, 3, 5), D(2024, 12, 31)]),
])
def test_parse_dates_formats(spark, text, expected):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(text)], "i int, date string")
    out = conform.parse_dates(df).orderBy("i")
    assert [r["date"] for r in out.collect()] == expected


def test_unparsable_dates_stay_text(spark):
    df = spark.createDataFrame([("yesterday",), ("2024-01-01",)], "date string")
    out = conform.parse_dates(df)
    assert dict(out.dtypes)["date"] == "string"


# ---------------------------------------------------------------------------
# missing values, duplicates
# ---------------------------------------------------------------------------

def test_fill_missing_median_mode_ties(spark):
    df = spark.createDataFrame([(1.0, "b"), (None, "a"), (3.0, None), (10.0, "b"), (None, "a")],
                               "quantity double, product string")
    out = conform.fill_missing(df)
    q = sorted(r["quantity"] for r in out.collect())
    assert q == [1.0, 3.0, 3.0, 3.0, 10.0]              # median of 1, 3, 10
    p = sorted(r["product"] for r in out.collect())
    assert p == ["a", "a", "a", "b", "b"]               # tie a/b → smallest


def test_mode_of_all_null_is_unknown(spark):
    df = spark.createDataFrame([(None,), (None,)], "region string")
    assert {r["region"] for r in conform.fill_missing(df).collect()} == {"Unknown"}


def test_drop_duplicates_subset_keeps_first(spark):
    df = spark.createDataFrame([(1, 2, "late"), (1, 1, "early"), (2, 5, "only")], "k int, t int, v string")
    out = conform.drop_duplicates(df, ["k"], order=["t"])
    assert sorted(rows(out, "k", "v")) == [(1, "early"), (2, "only")]


# ---------------------------------------------------------------------------
# status flag
# ---------------------------------------------------------------------------

def test_status_flag_contains_quirks(spark):
    df = spark.createDataFrame([("unpaid", 1.0), ("incomplete", 1.0), ("PAID!!", 1.0), ("Batal", 1.0)],
                               "status string, revenue double")
    got = dict(rows(conform.status_flag(df), "status", "is_successful_transaction"))
    assert got == {"unpaid": True, "incomplete": True, "PAID!!": True, "Batal": False}


def test_status_flag_all_unknown_is_all_true(spark):
    df = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "status string, revenue double")
    assert {r[0] for r in conform.status_flag(df).select("is_successful_transaction").collect()} == {True}


# ---------------------------------------------------------------------------
# rankings, RFM, declining, Pareto
# ---------------------------------------------------------------------------

def _sales(spark, data):
    return spark.createDataFrame(data, "date timestamp_ntz, product string, customer string, revenue double")


def test_rfm_equal_frequencies_score_three(spark):
    data = [(D(2024, 1, d), "p", c, float(d * 10 + i)) for i, c in enumerate("abcdef") for d in (1, 2)]
    out = customers.rfm(_sales(spark, data))
    assert {r["frequency_score"] for r in out.collect()} == {3}


def test_declining_products_ties_allowed_and_present_months(spark):
    data = [
        (D(2024, 1, 5), "A", "c", 5.0), (D(2024, 2, 5), "A", "c", 5.0), (D(2024, 3, 5), "A", "c", 4.0),
        (D(2024, 2, 5), "B", "c", 5.0), (D(2024, 3, 5), "B", "c", 4.0),
        (D(2024, 1, 5), "C", "c", 9.0), (D(2024, 3, 5), "C", "c", 6.0), (D(2024, 5, 5), "C", "c", 3.0),
        (D(2024, 1, 5), "D", "c", 1.0), (D(2024, 2, 5), "D", "c", 2.0), (D(2024, 3, 5), "D", "c", 1.0),
    ]
    got = {r["product"]: r["decline_pct"] for r in growth.declining_products(_sales(spark, data)).collect()}
    assert set(got) == {"A", "C"}
    assert got["A"] == pytest.approx(20.0) and got["C"] == pytest.approx(200 / 3)


def test_pareto_crossing_product_excluded(spark):
    data = [(D(2024, 1, 1), p, "c", v) for p, v in [("a", 50.0), ("b", 25.0), ("c", 15.0), ("d", 10.0)]]
    p = {r["product"]: (r["cumpct"], r["in_top"], r["rank"]) for r in growth.pareto(_sales(spark, data)).collect()}
    assert p["a"] == (50.0, True, 1) and p["b"] == (75.0, True, 2)
    assert p["c"][1] is False and p["c"][0] == pytest.approx(90.0)


def test_top_products_tie_broken_by_name(spark):
    data = [(D(2024, 1, 1), p, "c", 10.0) for p in ["b", "a", "c"]]
    out = dims.top_products(_sales(spark, data), 2)
    assert rows(out.orderBy("rank"), "product", "rank") == [("a", 1), ("b", 2)]


# ---------------------------------------------------------------------------
# profit, tiers, periods, growth
# ---------------------------------------------------------------------------

def test_zero_revenue_margin_is_null(spark):
    df = spark.createDataFrame([("a", 0.0, 5.0), ("b", 10.0, 4.0)], "product string, revenue double, cost double")
    got = dict(rows(profit.profitability_product(df), "product", "margin_pct"))
    assert got["a"] is None and got["b"] == pytest.approx(60.0)


def test_price_tier_edges(spark):
    df = spark.createDataFrame([(x,) for x in [-1.0, 0.0, 1.0, 2.0, 3.0, 4.0, None]], "price double")
    out = df.withColumn("t", price_tier_expr(F.col("price"), 1.5, 3.0))
    assert rows(out, "price", "t") == [(-1.0, None), (0.0, None), (1.0, "Low"), (2.0, "Medium"),
                                       (3.0, "Medium"), (4.0, "High"), (None, None)]
    same = df.withColumn("t", price_tier_expr(F.col("price"), 2.0, 2.0))
    assert {r["t"] for r in same.collect()} == {None}


def test_region_only_before_mid_vanishes(spark):
    df = spark.createDataFrame([(D(2024, 1, 1), "old", 5.0), (D(2024, 1, 1), "both", 1.0),
                                (D(2024, 1, 31), "both", 2.0), (D(2024, 1, 31), "new", 3.0)],
                               "date timestamp_ntz, region string, revenue double")
    got = {r["region"]: (r["revenue"], r["revenue_prev"], r["transactions"])
           for r in growth.period_half_compare(df, "region").collect()}
    assert got == {"both": (2.0, 1.0, 1), "new": (3.0, 0.0, 1)}


def test_growth_dim_zero_rules(spark):
    df = spark.createDataFrame([(D(2024, 1, 5), "a", 0.0), (D(2024, 2, 5), "a", 5.0),
                                (D(2024, 1, 5), "b", 0.0), (D(2024, 2, 5), "b", 0.0),
                                (D(2024, 1, 5), "c", 4.0), (D(2024, 2, 5), "c", 2.0)],
                               "date timestamp_ntz, product string, revenue double")
    got = dict(rows(growth.growth_dim(df, "product", "M", 10), "product", "growth_pct"))
    assert got == {"a": 100.0, "b": 0.0, "c": -50.0}


def test_kpi_board_mom_needs_two_months(spark):
    df = spark.createDataFrame([(D(2024, 1, 5), 10.0, 1.0)], "date timestamp_ntz, revenue double, quantity double")
    r = kpi.kpi_board(df).first()
    assert r["mom_pct"] is None and r["yoy_pct"] is None
    assert r["gross_profit"] == pytest.approx(3.0)       # flat 30 % margin


def test_format_currency(spark):
    df = spark.createDataFrame([(x,) for x in [2.5e12, 3.45e9, 1_250_000.0, 999.4, -1500.0, 1999.5]], "v double")
    out = df.select(scalar.format_currency(F.col("v")).alias("c"), scalar.format_deck(F.col("v")).alias("d"))
    assert [tuple(r) for r in out.collect()] == [
        ("Rp 2.5T", "Rp 2.5T"), ("Rp 3.5B", "Rp 3.45M"), ("Rp 1.3M", "Rp 1.3Jt"),
        ("Rp 999", "Rp 999"), ("Rp -1.5K", "Rp -1500"), ("Rp 2.0K", "Rp 2K")]


def test_finite_or_zero(spark):
    df = spark.createDataFrame([(float("inf"),), (float("nan"),), (None,), (2.0,)], "v double")
    assert [r[0] for r in df.select(scalar.finite_or_zero(F.col("v"))).collect()] == [0.0, 0.0, 0.0, 2.0]


# ---------------------------------------------------------------------------
# ordered operators vs brute force, independent of the partitioning
# ---------------------------------------------------------------------------

@pytest.fixture(scope="module")
def seq(spark):
    rng = np.random.default_rng(7)
    n = 3000
    pdf = pd.DataFrame({"k": rng.permutation(n), "g": rng.integers(0, 3, n),
                        "v": np.round(rng.normal(100, 30, n), 2)})
    pdf.loc[rng.choice(n, 400, replace=False), "v"] = np.nan
    return pdf


@pytest.mark.parametrize("partitions", [1, 64])
def test_row_lags_and_ffill_match_pandas(spark, seq, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(seq.fillna({"v": 0.0}))
        got = ordered.row_lags(df, ["k"], "v").toPandas().sort_values("k").reset_index(drop=True)
        ref = seq.fillna({"v": 0.0}).sort_values("k").reset_index(drop=True)
        assert np.allclose(got["v_lag_1"], ref["v"].shift(1), equal_nan=True)
        assert np.allclose(got["v_lag_7"], ref["v"].shift(7), equal_nan=True)
        assert np.allclose(got["v_rolling_mean_7"], ref["v"].rolling(7).mean(), equal_nan=True)
        assert np.allclose(got["v_rolling_std_7"], ref["v"].rolling(7).std(), equal_nan=True)

        df2 = spark.createDataFrame(seq)
        ff = ordered.forward_fill(df2, ["k"], ["v"]).toPandas().sort_values("k").reset_index(drop=True)
        assert np.allclose(ff["v"], seq.sort_values("k")["v"].ffill().to_numpy(), equal_nan=True)

        rs = ordered.running_sum(df, [F.col("v").desc(), F.col("k")], "v", "cs", "rank").toPandas()
        rs = rs.sort_values("rank")
        ref2 = seq.fillna({"v": 0.0}).sort_values(["v", "k"], ascending=[False, True])
        assert np.allclose(rs["cs"].to_numpy(), ref2["v"].cumsum().to_numpy())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_exact_quantiles_match_numpy_with_hot_values(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vals = np.concatenate([rng.normal(0, 1, 4000).round(3), np.full(2500, 0.5)])   # a third is one value
    df = spark.createDataFrame(pd.DataFrame({"x": vals}))
    monkeypatch.setattr(ordered, "LOCAL_RANK_LIMIT", 100)      # force the narrowing rounds
    qs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.999, 1.0]
    got = ordered.exact_quantiles(df, "x", qs)
    assert np.allclose(got, np.quantile(vals, qs))


# -- whole numbers, types, headers, files ------------------------------------

def test_fill_missing_keeps_fractions_of_whole_columns(spark):
    df = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 8), (5, None)], "k int, quantity long")
    got = {r["k"]: r["quantity"] for r in conform.fill_missing(df, {"quantity": "median"}).collect()}
    assert got[5] == 2.5 and got[4] == 8.0
    got = {r["k"]: r["quantity"] for r in conform.fill_missing(df, {"quantity": "mean"}).collect()}
    assert got[5] == 3.5
    odd = spark.createDataFrame([(1, 1), (2, 3), (3, 8), (4, None)], "k int, quantity long")
    out = conform.fill_missing(odd, {"quantity": "median"})
    assert dict(out.dtypes)["quantity"] == "bigint"
    assert {r["quantity"] for r in out.where("k = 4").collect()} == {3}


def test_forward_fill_keeps_every_type(spark):
    import datetime as dt
    from decimal import Decimal
    rows = [(i, i * 3 if i % 4 else None, i % 3 == 0 if i % 5 else None, dt.date(2024, 1, 1 + i % 28) if i % 3 else None,
             Decimal(i) / 4 if i % 6 else None, f"s{i}" if i % 7 == 1 else None, 2 ** 60 + i if i % 9 == 2 else None)
            for i in range(200)]
    df = spark.createDataFrame(rows, "k int, a int, b boolean, c date, d decimal(10,2), e string, f long").repartition(5)
    cols = ["a", "b", "c", "d", "e", "f"]
    got = sorted(ordered.forward_fill(df, ["k"], cols).collect())
    last = [None] * 6
    for r, src in zip(got, rows):
        last = [x if x is not None else y for x, y in zip(src[1:], last)]
        assert list(r)[1:] == last


def test_headers_that_collide(spark):
    df = spark.createDataFrame([("a", "b", "c", "d")], ["Nama Pelanggan", "Customer", "Store X", "store x"])
    out = conform.standardize_columns(df)
    assert len(set(out.columns)) == len(out.columns)
    row = out.first()
    assert row["customer"] in ("a", "b") and {"a", "b"} <= set(row.asDict().values())


def test_status_probe_sees_all_values(spark):
    words = ["completed", "cancelled", "pending", "refund", "paid", "unpaid", "shipped", "success"]
    late = spark.createDataFrame([(f"aaa{i}",) for i in range(40)] + [(w,) for w in words], "product string")
    assert conform.product_valid(late)          # 8 of 48
    many = spark.createDataFrame([(f"aaa{i}",) for i in range(10)] + [(w,) for w in words], "product string")
    assert not conform.product_valid(many)      # 8 of 18


def test_csv_quotes_encodings_and_bad_uploads(spark, tmp_path):
    from salescope.sources import files
    (tmp_path / "q.csv").write_text('name,n\n"a ""b"", c",1\n"two\nlines",2\n', encoding="utf-8")
    rows = files.load_data(spark, str(tmp_path / "q.csv"), multiline=True).collect()
    assert [r["name"] for r in rows] == ['a "b", c', "two\nlines"]
    folder = tmp_path / "up.csv"
    folder.mkdir()
    body = "name,n\n" + "x,1\n" * 12_000
    (folder / "a.csv").write_bytes((body + "café,2\n").encode("latin-1"))
    (folder / "b.csv").write_bytes((body + "thé �,3\n").encode("utf-8"))
    got = {r["name"] for r in files.load_data(spark, str(folder)).where("n > 1").collect()}
    assert got == {"café", "thé �"}
    df, skipped = files.read_uploads(spark, [str(tmp_path / "q.csv"), str(tmp_path / "none.csv"), "x.doc"])
    assert df is not None and set(skipped) == {str(tmp_path / "none.csv"), "x.doc"}


def test_isolation_forest_is_the_same_in_any_partitioning(spark):
    from salescope.models.anomaly import fit_isolation_forest
    rows = [(i, float(i * 37 % 101), float(i % 7)) for i in range(3_000)]
    df = spark.createDataFrame(rows, "k int, revenue double, quantity double")
    offsets = {fit_isolation_forest(df.repartition(n), n_trees=20).offset for n in (1, 7, 64)}
    assert len(offsets) == 1


def test_subset_dedupe_without_an_order_keeps_the_same_row_everywhere(spark):
    rows = [("a", i % 7, f"v{i}") for i in range(60)] + [(None, None, "x"), (None, 3, "y"), ("b", 2, "z"), ("b", 2, "w")]
    df = spark.createDataFrame(rows, "k string, n int, t string")
    want = {(None, None, "x"), ("a", 0, "v0"), ("b", 2, "w")}
    for p in (1, 6):
        assert {tuple(r) for r in conform.drop_duplicates(df.repartition(p), ["k"]).collect()} == want
    # ties of the order are decided by the other columns
    tied = {tuple(r) for r in conform.drop_duplicates(df.repartition(5), ["k"], order=["n"]).collect()}
    assert tied == want
    assert conform.drop_duplicates(df, ["k", "n", "t"]).count() == 64


@pytest.mark.parametrize("block", [1, 4, 32])
def test_lags_do_not_depend_on_where_files_are_split(spark, monkeypatch, block):
    rng = random.Random(3)
    table = [(i // 2, i, None if i % 11 == 5 else float("nan") if i % 41 == 7 else round(rng.uniform(-9, 9), 2), None if i % 3 else f"ü{i}", [i, None])
            for i in range(3000)]
    rng.shuffle(table)
    df = spark.createDataFrame(table, "d int, k long, revenue double, `a b` string, x array<int>").repartition(3)
    monkeypatch.setattr(ordered, "BLOCK", block)
    conf, key = spark.sparkContext._jsc.hadoopConfiguration(), "spark.sql.files.maxPartitionBytes"
    conf.set("parquet.block.size", "2048")
    try:
        blocks = ordered.row_blocks(df, ["d", "k"], "revenue", (1, 3), 4)
    finally:
        conf.unset("parquet.block.size")
    before = spark.conf.get(key)
    spark.conf.set(key, "4096")
    try:
        out = ordered.row_lags(blocks, ["d", "k"], "revenue", (1, 3), 4)
        assert block == 32 or out.rdd.getNumPartitions() > 8   # more than there are files
        got = sorted(out.collect(), key=lambda r: r["k"])
        assert sorted(blocks.rows("a b", "k").collect(), key=lambda r: r["k"]) == [(r["a b"], r["k"]) for r in got]
    finally:
        spark.conf.set(key, before)
    value = pd.Series([math.nan if r["revenue"] is None else r["revenue"] for r in got])
    assert [r["k"] for r in got] == list(range(3000)) and got[3]["a b"] == "ü3" and got[4]["x"] == [4, None]
    want = {"revenue_lag_1": value.shift(1), "revenue_lag_3": value.shift(3),
            "revenue_rolling_mean_4": value.rolling(4).mean(), "revenue_rolling_std_4": value.rolling(4).std()}
    for name, w in want.items():
        for r, x in zip(got, w):
            assert (r[name] is None) == math.isnan(x) and (r[name] is None or abs(r[name] - x) < 1e-9), (name, r["k"])


def test_lags_of_nothing(spark):
    from salescope.operators.ordered import row_lags
    df = spark.createDataFrame([(1, 2.0)], "k long, revenue double")
    assert row_lags(df.where("k > 1"), ["k"], "revenue").count() == 0
    assert [tuple(r) for r in row_lags(df, ["k"], "revenue").collect()] == [(1, 2.0, None, None, None, None)]
