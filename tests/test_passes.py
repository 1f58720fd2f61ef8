"""How often operators evaluate their input: a counting function stands for
the joins that an input may consist of."""

from __future__ import annotations

import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from salescope.functions import fixed
from salescope.models import anomaly
from salescope.operators import conform


def counted(spark, df, col):
    """(df with ``col`` passed through a counting function, its counter)."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf(df.schema[col].dataType)
    def through(x):
        calls.add(1)
        return x

    return df.withColumn(col, through.asNondeterministic()(col)), calls


@pytest.mark.parametrize("texts, fmt, left", [
    (["01/02/2020", "31/12/2021", None, "05/06/2020"], "d/M/yyyy", 1),
    (["01/31/2020", "12/25/2021"], "M/d/yyyy", 1),
    (["01/02/2020", "11/12/2020", "03/25/2020", "02/28/2021"], "M/d/yyyy", 2),   # its ends fit d/M as well
    (["January 05, 2020", "May 31, 2020"], "MMMM d, yyyy", 1),
    (["x", "2020-01-01"], None, 0),
])
def test_formats_are_tested_on_all_texts_but_those_an_end_excludes(spark, monkeypatch, texts, fmt, left):
    tested = []
    whole = conform._parsing_all
    monkeypatch.setattr(conform, "_parsing_all", lambda rows, formats: (tested.append(len(formats)), whole(rows, formats))[1])
    assert conform.choose_date_format(spark.createDataFrame([(t,) for t in texts * 3], "date string")) == fmt
    assert tested[0] == len(fixed.DATE_FORMATS) + 1
    assert left <= tested[1] < 8


def test_no_text_at_all_takes_the_first_format(spark):
    assert conform.choose_date_format(spark.createDataFrame([(None,)], "date string")) == fixed.DATE_FORMATS[0]


def test_status_probes_read_the_input_once(spark):
    rows = [("completed", "A", "web"), ("pending", "B", None), (None, " completed ", "shop")] * 5
    df, calls = counted(spark, spark.createDataFrame(rows, "product string, category string, channel string"), "category")
    assert conform.status_shares(df, ["product", "category", "channel"]) == {
        "product": 1.0, "category": pytest.approx(1 / 3), "channel": 0.0}
    calls.value = 0
    out = conform.standardize_columns(df)
    assert calls.value == len(rows)          # was read by three probes
    assert sorted(r["product"] for r in out.collect()) == sorted([r[1] for r in rows])


def test_fill_missing_reads_the_input_once(spark):
    rows = [(i, None if i % 7 == 0 else float(i), None if i % 5 == 0 else "ab"[i % 2]) for i in range(50)]
    df, calls = counted(spark, spark.createDataFrame(rows, "k int, price double, product string"), "price")
    out = conform.fill_missing(df)
    got = {r["k"]: (r["price"], r["product"]) for r in out.collect()}
    assert calls.value == len(rows)
    assert got[0] == (24.5, "a") and got[10][1] == "a" and got[1] == (1.0, "b")
    assert out.columns == df.columns


def test_stored_rows_keep_any_header_and_type(spark):
    from salescope.session import store
    df = spark.sql("select 1 as `a b;=`, timestamp_ntz'2020-01-01 01:02:03' as t, null as nothing, array(1, null) as x")
    assert store(df).collect() == df.collect()
    assert store(df.drop("nothing")).collect() == df.drop("nothing").collect()
    assert store(df).columns == df.columns


def test_forest_reads_the_input_once(spark):
    df, calls = counted(spark, spark.createDataFrame([(float(i % 17), float(i)) for i in range(300)],
                                                     "revenue double, quantity double"), "revenue")
    model = anomaly.fit_isolation_forest(df, n_trees=5)
    assert calls.value == 300
    calls.value = 0
    assert anomaly.isolation_forest(df).count() == 300
    assert calls.value == 300
    assert model.offset == anomaly.fit_isolation_forest(df, n_trees=5).offset


def test_preprocess_reads_the_input_once(spark):
    rows = [(f"{1 + i % 28:02d}/03/2021", i, f"P{i % 4}", "C", float(i % 9) if i % 6 else None, 2.5 + i % 5, "Completed")
            for i in range(60)]
    df, calls = counted(spark, spark.createDataFrame(rows, "Tanggal string, `No Order` int, `Nama Produk` string, "
                                                     "Kategori string, Qty double, Harga double, Status string"), "Harga")
    out = conform.preprocess(df, order=["date", "order_id"])
    got = out.collect()
    assert calls.value == len(rows)
    assert len(got) == len(rows) and out.columns[0] == "product"
    assert out.columns[-4:] == ["revenue_lag_1", "revenue_lag_7", "revenue_rolling_mean_7", "revenue_rolling_std_7"]
    by = sorted(got, key=lambda r: (r["date"], r["order_id"]))
    assert [r["revenue_lag_1"] for r in by[1:]] == [r["revenue"] for r in by[:-1]]
    assert by[0]["date"] == dt.datetime(2021, 3, 1) and by[0]["product_freq"] == 15


def _files(spark, *folders):
    base = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    return {os.path.join(at, f) for folder in folders for at, _, files in os.walk(os.path.join(base, folder)) for f in files}


def _shuffle_files(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in dirs for _, _, files in os.walk(d) for f in files if f.startswith("shuffle_")}


def _upload(spark, n=60):
    rows = [(f"{1 + i % 28:02d}/03/2021", i, f"P{i % 4}", float(i % 9) if i % 6 else None, 2.5 + i % 5, "Completed", float(i * i % 31))
            for i in range(n)]
    return spark.createDataFrame(rows + rows[::3], "Tanggal string, `No Order` int, `Nama Produk` string, Qty double, "
                                 "Harga double, Status string, `Grand Total` double").repartition(3)


def test_preprocess_leaves_one_copy_of_the_rows(spark):
    df, before = _upload(spark), _files(spark, "")
    out = conform.preprocess(df, order=["date", "order_id", "product", "quantity", "price", "revenue", "status"])
    left = {f.split("salescope-tables/")[-1].split("/")[0] for f in _files(spark, "") - before}
    assert len(left) == 2 and all(t.startswith("rows-") for t in left)   # the distinct rows and the products' statistics; no checkpoint
    assert not spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "true"
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
    assert out.count() == 60


def test_distinct_rows_and_lags_share_a_shuffle(spark, monkeypatch):
    from salescope.operators import ordered
    plans = []
    monkeypatch.setattr(ordered, "store", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), store(df))[1])
    from salescope.session import store
    order = ["date", "order_id", "product", "quantity", "price", "revenue", "status"]
    shared = conform.preprocess(_upload(spark), order=order)
    assert plans[0].count("rangepartitioning") == 1 and "hashpartitioning" not in plans[0].split("Subquery")[0]
    lags = [c for c in shared.columns if c.startswith("revenue_")]
    alone = conform.preprocess(_upload(spark), order=["revenue", *order])   # revenue may be made anew: two shuffles
    assert shared.drop(*lags).exceptAll(alone.drop(*lags)).isEmpty() and shared.count() == alone.count() == 60


def test_a_stored_table_leaves_no_shuffle_files(spark):
    from salescope.session import discard, store
    before, files = _shuffle_files(spark), _files(spark, "salescope-tables")
    out = store(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    until = time.time() + 20
    while _shuffle_files(spark) - before and time.time() < until:   # they go in the background
        time.sleep(0.2)
    assert not _shuffle_files(spark) - before
    assert out.count() == 7
    discard(out)
    assert _files(spark, "salescope-tables") == files


def test_the_status_words_are_sought_in_distinct_values(spark):
    df = spark.createDataFrame([("Completed", 1.0), ("Open", 2.0), (None, 3.0)] * 5, "status string, revenue double")
    out = conform.status_flag(df)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [status") == 1   # a plain distinct below a maximum is dropped
    assert {(r["status"], r["is_successful_transaction"]) for r in out.collect()} == {("Completed", True), ("Open", False), (None, False)}


def _tables(spark, name):
    base = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    folder = os.path.join(base, "salescope-llm")
    return {t for t in (os.listdir(folder) if os.path.isdir(folder) else []) if t.startswith(name)}


def test_steps_of_the_pipeline_leave_no_passing_tables(spark):
    from salescope.llm import line_dedup, mixing, superminhash
    rows = [(i, f"one line {i % 4}\nand these are the words of text number {i} " + "so it goes " * (i % 6), f"s{i % 3}", 1)
            for i in range(40)] + [(99, None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int")
    for step, name, left in ((line_dedup.drop_lines, "lines", 1), (superminhash.keep_one, "minhash", 1),
                             (mixing.mix_documents, "mix", 1)):
        before = _tables(spark, name)
        out = step(docs)
        assert len(_tables(spark, name) - before) == left, name
        assert out.count() > 0


def test_mixed_documents_have_one_python_step_after_the_text_join(spark):
    from salescope.llm import mixing
    docs = spark.createDataFrame([(i, f"words of {i} " * 9, f"s{i % 2}") for i in range(20)], "doc_id long, text string, source string")
    out = mixing.mix_documents(docs)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
