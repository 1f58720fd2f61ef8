"""Conforming and cleaning queries.

Each query derives a "raw upload" from the star-schema tables inside the
plan — renamed headers, dates as text, nulls and duplicate rows placed by a
fixed rule on the row key — so the oracle sees exactly the same input.  The
rules only dirty values; every row of the tables is processed.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import conform, kpi
from ..sources.tables import ROW_ORDER, sales_view
from .registry import query, rnd, view, with_sales

KEYS = ["order_id", "line_no", "part_id", "supplier_id"]
KEYS_SQL = "order_id, line_no, part_id, supplier_id"

# raw upload headers for the canonical columns (an Indonesian-style export)
RAW_HEADERS = {
    "date": "Tanggal", "order_id": "No Order", "product": "Nama Produk", "category": "Kategori",
    "customer": "Pelanggan", "region": "Kota", "store": "Nama Toko", "channel": "Channel",
    "salesperson": "Salesperson", "quantity": "Qty", "price": "Harga Satuan", "cost": "HPP",
    "revenue": "Grand Total", "status": "Status",
}


def raw_upload(spark, d, cols: list[str]):
    v = view(spark, d, *cols)
    return v.select(*[F.col(c).alias(RAW_HEADERS.get(c, c)) for c in cols])


@query("standardize_columns", with_sales("""
SELECT date, order_id, product, category, customer, region, store, channel, salesperson,
       quantity, price, cost AS hpp, revenue, status
FROM sales
"""))
def q_standardize(spark, d):
    cols = ["date", "order_id", "product", "category", "customer", "region", "store", "channel",
            "salesperson", "quantity", "price", "cost", "revenue", "status"]
    return conform.standardize_columns(raw_upload(spark, d, cols))


@query("normalize_headers", with_sales("""
SELECT date AS tanggal, order_id AS no_order, product AS nama_produk, revenue AS grand_total FROM sales
"""))
def q_normalize_headers(spark, d):
    return conform.normalize_headers(raw_upload(spark, d, ["date", "order_id", "product", "revenue"]))


@query("proxy_columns", with_sales("""
SELECT date, category, channel, store, revenue, category AS product, store AS region FROM sales
"""))
def q_proxy_columns(spark, d):
    # the product header holds order statuses: it is dropped and replaced by
    # the category; there is no region, so the store stands in for it
    v = view(spark, d, "date", "category", "channel", "store", "status", "revenue")
    raw = v.select(F.col("date").alias("Tanggal"), F.col("status").alias("Nama Produk"),
                   F.col("category").alias("Kategori"), F.col("channel").alias("Channel"),
                   F.col("store").alias("Nama Toko"), F.col("revenue").alias("Grand Total"))
    return conform.standardize_columns(raw)


_PROBE_SQL = """
, probe AS (SELECT v FROM (SELECT DISTINCT lower(trim(CAST({col} AS VARCHAR))) AS v FROM sales
                           WHERE {col} IS NOT NULL))
"""
_STATUS_WORDS_SQL = "(" + ", ".join(f"'{w}'" for w in fixed.STATUS_LIKE_VALUES) + ")"


@query("product_valid", with_sales(
    _PROBE_SQL.format(col="product") + _PROBE_SQL.replace("probe", "probe_s").format(col="status") + f"""
SELECT (SELECT count_if(v IN {_STATUS_WORDS_SQL}) * 1.0 / count(*) <= 0.4 FROM probe) AS product_valid,
       (SELECT count_if(v IN {_STATUS_WORDS_SQL}) * 1.0 / count(*) <= 0.4 FROM probe_s) AS status_as_product_valid
"""))
def q_product_valid(spark, d):
    v = view(spark, d, "product", "status")
    ok_product = conform.product_valid(v)
    ok_status = conform.product_valid(v.select(F.col("status").alias("product")))
    return spark.range(1).select(F.lit(ok_product).alias("product_valid"),
                                 F.lit(ok_status).alias("status_as_product_valid"))


def _text_dates(spark, d, pattern: str):
    v = view(spark, d, *KEYS, "date")
    # line 7 carries no date: exercises null handling
    txt = F.when(F.col("line_no") == 7, F.lit(None)).otherwise(F.date_format("date", pattern))
    return v.withColumn("date", txt)


_PARSED_SQL = with_sales(f"""
SELECT {KEYS_SQL}, CASE WHEN line_no = 7 THEN NULL ELSE date END AS date FROM sales
""")


@query("parse_dates", _PARSED_SQL)
def q_parse_dates(spark, d):
    return conform.parse_dates(_text_dates(spark, d, "dd/MM/yyyy"))


@query("parse_dates_us", _PARSED_SQL)
def q_parse_dates_us(spark, d):
    return conform.parse_dates(_text_dates(spark, d, "MM/dd/yyyy"))


@query("parse_dates_month_name", _PARSED_SQL)
def q_parse_dates_names(spark, d):
    return conform.parse_dates(_text_dates(spark, d, "MMMM dd, yyyy"))


@query("drop_null_dates", with_sales(f"""
SELECT {KEYS_SQL}, date FROM sales WHERE line_no <> 7
"""))
def q_drop_null_dates(spark, d):
    return conform.drop_null_dates(conform.parse_dates(_text_dates(spark, d, "yyyy-MM-dd")))


def _holes(spark, d):
    v = view(spark, d, *ROW_ORDER, "product", "region", "quantity", "price")
    return v.withColumns({
        "quantity": F.when(F.col("line_no") == 3, F.lit(None)).otherwise(F.col("quantity")),
        "price": F.when(F.col("line_no") == 4, F.lit(None)).otherwise(F.col("price")),
        "product": F.when(F.col("line_no") == 5, F.lit(None)).otherwise(F.col("product")),
        "region": F.when(F.col("line_no") == 2, F.lit(None)).otherwise(F.col("region")),
    })


@query("fill_missing", with_sales(f"""
, raw AS (SELECT {KEYS_SQL},
                 CASE WHEN line_no = 3 THEN NULL ELSE quantity END AS quantity,
                 CASE WHEN line_no = 4 THEN NULL ELSE price END AS price,
                 CASE WHEN line_no = 5 THEN NULL ELSE product END AS product,
                 CASE WHEN line_no = 2 THEN NULL ELSE region END AS region FROM sales)
SELECT {KEYS_SQL},
       coalesce(quantity, (SELECT quantile_cont(quantity, 0.5) FROM raw)) AS quantity,
       round(coalesce(price, (SELECT quantile_cont(price, 0.5) FROM raw)), 6) AS price,
       coalesce(product, (SELECT product FROM raw WHERE product IS NOT NULL GROUP BY product
                          ORDER BY count(*) DESC, product LIMIT 1)) AS product,
       coalesce(region, (SELECT region FROM raw WHERE region IS NOT NULL GROUP BY region
                         ORDER BY count(*) DESC, region LIMIT 1)) AS region
FROM raw
"""))
def q_fill_missing(spark, d):
    out = conform.fill_missing(_holes(spark, d))
    return rnd(out.select(*KEYS, "quantity", "price", "product", "region"), [], ["price"])


@query("ffill", with_sales(f"""
SELECT {KEYS_SQL},
       round(last_value(CASE WHEN line_no IN (2, 3) THEN NULL ELSE price END IGNORE NULLS)
             OVER (ORDER BY date, order_id, line_no, part_id, supplier_id, ship_date, revenue
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS price
FROM sales
"""))
def q_ffill(spark, d):
    v = view(spark, d, *ROW_ORDER, "price")
    v = v.withColumn("price", F.when(F.col("line_no").isin(2, 3), F.lit(None)).otherwise(F.col("price")))
    out = conform.fill_missing(v, {"price": "ffill"}, order=ROW_ORDER)
    return rnd(out.select(*KEYS, "price"), [], ["price"])


@query("drop_duplicates", with_sales(f"""
SELECT DISTINCT {KEYS_SQL}, date, round(revenue, 4) AS revenue FROM sales
"""))
def q_drop_duplicates(spark, d):
    v = view(spark, d, *KEYS, "date", "revenue")
    v = rnd(v, ["revenue"])
    # every first line of an order is uploaded twice
    doubled = v.unionByName(v.where(F.col("line_no") == 1))
    return conform.drop_duplicates(doubled)


@query("drop_duplicates_subset", with_sales(f"""
SELECT {KEYS_SQL}, date, revenue FROM (
  SELECT {KEYS_SQL}, date, round(revenue, 4) AS revenue,
         row_number() OVER (PARTITION BY order_id ORDER BY line_no, part_id, supplier_id, date, revenue) AS rn
  FROM sales) t WHERE rn = 1
"""))
def q_drop_duplicates_subset(spark, d):
    v = rnd(view(spark, d, *KEYS, "date", "revenue"), ["revenue"])
    return conform.drop_duplicates(v, subset=["order_id"],
                                   order=["line_no", "part_id", "supplier_id", "date", "revenue"])


@query("status_flag", with_sales("""
, x AS (SELECT status, coalesce(regexp_matches(trim(regexp_replace(regexp_replace(lower(trim(status)),
                 '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')),
                 'selesai|completed|complete|sukses|success|berhasil|lunas|paid|delivered|terkirim|diterima|confirmed|terkonfirmasi|approved|disetujui|finish|done|pesanan selesai|order selesai|transaksi selesai|order completed'), false) AS hit
        FROM sales)
SELECT status, CASE WHEN (SELECT bool_or(hit) FROM x) THEN hit ELSE true END AS is_successful_transaction,
       count(*) AS transactions
FROM x GROUP BY 1, 2
"""))
def q_status_flag(spark, d):
    out = conform.status_flag(view(spark, d, "status", "revenue"))
    return out.groupBy("status", "is_successful_transaction").agg(F.count(F.lit(1)).alias("transactions"))


@query("status_flag_fallback", with_sales("""
SELECT CASE status WHEN 'Completed' THEN 'Closed' ELSE status END AS status,
       true AS is_successful_transaction, count(*) AS transactions
FROM sales GROUP BY 1
"""))
def q_status_flag_fallback(spark, d):
    v = view(spark, d, "status", "revenue")
    v = v.withColumn("status", F.when(F.col("status") == "Completed", F.lit("Closed")).otherwise(F.col("status")))
    out = conform.status_flag(v)
    return out.groupBy("status", "is_successful_transaction").agg(F.count(F.lit(1)).alias("transactions"))


@query("derive_revenue", with_sales(f"""
SELECT {KEYS_SQL}, round(quantity * price, 4) AS revenue FROM sales
"""))
def q_derive_revenue(spark, d):
    v = view(spark, d, *KEYS, "quantity", "price")   # no revenue column
    return rnd(conform.derive_revenue(v).select(*KEYS, "revenue"), ["revenue"])


@query("to_numeric", with_sales(f"""
SELECT {KEYS_SQL}, coalesce(TRY_CAST(CASE WHEN line_no = 6 THEN 'n/a' ELSE CAST(quantity AS VARCHAR) END AS DOUBLE), 0)
       AS quantity FROM sales
"""))
def q_to_numeric(spark, d):
    from ..operators.common import to_numeric
    v = view(spark, d, *KEYS, "quantity")
    txt = F.when(F.col("line_no") == 6, F.lit("n/a")).otherwise(F.col("quantity").cast("string"))
    return v.withColumn("quantity", to_numeric(txt))


@query("filter_sales", with_sales(f"""
SELECT {KEYS_SQL}, date, category, region, channel, round(revenue, 4) AS revenue FROM sales
WHERE CAST(date AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'
  AND category IN ('ECONOMY', 'PROMO', 'STANDARD')
  AND region IN ('NATION_1', 'NATION_3', 'NATION_5', 'NATION_7', 'NATION_11', 'NATION_13')
  AND channel IN ('1-URGENT', '2-HIGH', '5-LOW')
"""))
def q_filter_sales(spark, d):
    v = view(spark, d, *KEYS, "date", "category", "region", "channel", "revenue")
    out = conform.filter_sales(
        v, "1996-01-01", "1997-12-31",
        categories=["ECONOMY", "PROMO", "STANDARD"],
        regions=["NATION_1", "NATION_3", "NATION_5", "NATION_7", "NATION_11", "NATION_13"],
        channels=["1-URGENT", "2-HIGH", "5-LOW"])
    return rnd(out, ["revenue"])


@query("last_n_days", with_sales(f"""
SELECT {KEYS_SQL}, date, round(revenue, 4) AS revenue FROM sales
WHERE date > (SELECT max(date) FROM sales) - INTERVAL 90 DAY
"""))
def q_last_n_days(spark, d):
    return rnd(conform.last_n_days(view(spark, d, *KEYS, "date", "revenue"), 90), ["revenue"])


def _summary_sql() -> str:
    parts = []
    for name, dtype, numeric in [("date", "timestamp_ntz", False), ("product", "string", False),
                                 ("quantity", "double", True), ("price", "double", True),
                                 ("revenue", "double", True)]:
        if numeric:
            stats = (f"count({name}) AS count, round(avg({name}), 6) AS mean, round(stddev_samp({name}), 6) AS std, "
                     f"round(min({name}), 6) AS min, round(quantile_cont({name}, 0.25), 6) AS q25, "
                     f"round(quantile_cont({name}, 0.5), 6) AS q50, round(quantile_cont({name}, 0.75), 6) AS q75, "
                     f"round(max({name}), 6) AS max")
        else:
            stats = ("CAST(NULL AS BIGINT) AS count, CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std, "
                     "CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS q25, CAST(NULL AS DOUBLE) AS q50, "
                     "CAST(NULL AS DOUBLE) AS q75, CAST(NULL AS DOUBLE) AS max")
        parts.append(f"SELECT '{name}' AS \"column\", '{dtype}' AS dtype, count_if({name} IS NULL) AS missing, {stats}, "
                     "count(*) AS total_rows, 5 AS total_columns, strftime(min(date), '%Y-%m-%d') AS date_min, "
                     "strftime(max(date), '%Y-%m-%d') AS date_max, datesub('day', min(date), max(date)) AS span_days "
                     "FROM sales")
    return with_sales("\nUNION ALL\n".join(parts))


@query("data_summary", _summary_sql())
def q_data_summary(spark, d):
    out = kpi.data_summary(view(spark, d, "date", "product", "quantity", "price", "revenue"))
    return rnd(out, [], ["mean", "std", "min", "q25", "q50", "q75", "max"])


_PRE_COLS = ["date", "order_id", "product", "category", "customer", "region", "channel", "quantity", "price", "revenue", "status"]
_PRE_ROUND = ["revenue"], ["product_avg_revenue", "revenue_lag_1", "revenue_lag_7", "revenue_rolling_mean_7", "revenue_rolling_std_7"]


def _preprocess_sql() -> str:
    """The steps one after another: gaps, medians and modes, distinct rows,
    success words, calendar, tiers, product and order features."""
    plain = ", ".join(c for c in _PRE_COLS if c not in ("quantity", "product", "price"))
    mode = "(SELECT {0} FROM raw WHERE {0} IS NOT NULL GROUP BY {0} ORDER BY count(*) DESC, {0} LIMIT 1)"
    words = "|".join(fixed.SUCCESS_KEYWORDS)
    shown = ", ".join(f"round({c}, 4) AS {c}" if c in _PRE_ROUND[0] else f"round({c}, 6) AS {c}" if c in _PRE_ROUND[1] else c
                      for c in [*_PRE_COLS, "is_successful_transaction", "year", "month", "quarter", "day_of_week", "day_of_month",
                                "week_of_year", "is_weekend", "month_name", "year_month", "revenue_per_unit", "price_tier", "product_freq",
                                *_PRE_ROUND[1]])
    return with_sales(f"""
, dirty AS (SELECT {plain}, CASE WHEN order_id % 50 = 0 THEN NULL ELSE quantity END AS quantity,
              CASE WHEN order_id % 41 = 0 THEN NULL ELSE product END AS product,
              CASE WHEN order_id % 67 = 0 THEN NULL ELSE price END AS price FROM sales)
, raw AS MATERIALIZED (SELECT * FROM dirty UNION ALL SELECT * FROM dirty WHERE order_id % 10 = 0)
, u AS MATERIALIZED (SELECT DISTINCT {plain}, coalesce(quantity, (SELECT quantile_cont(quantity, 0.5) FROM raw)) AS quantity,
              coalesce(product, {mode.format("product")}) AS product, coalesce(price, (SELECT quantile_cont(price, 0.5) FROM raw)) AS price FROM raw)
, q AS (SELECT quantile_cont(price, 0.25) AS q25, quantile_cont(price, 0.75) AS q75 FROM u)
, f AS (SELECT u.*, coalesce(regexp_matches(trim(regexp_replace(regexp_replace(lower(trim(status)), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')),
                 '{words}'), false) AS hit,
              year(date) AS year, month(date) AS month, quarter(date) AS quarter, isodow(date) - 1 AS day_of_week, day(date) AS day_of_month,
              weekofyear(date) AS week_of_year, CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS is_weekend,
              strftime(date, '%B') AS month_name, strftime(date, '%Y-%m') AS year_month,
              CASE WHEN quantity = 0 THEN NULL ELSE revenue / quantity END AS revenue_per_unit,
              CASE WHEN NOT (0 < q25 AND q25 < q75) OR price <= 0 THEN NULL WHEN price <= q25 THEN 'Low' WHEN price <= q75 THEN 'Medium'
                   WHEN price IS NOT NULL THEN 'High' END AS price_tier,
              count(*) OVER (PARTITION BY product) AS product_freq, avg(revenue) OVER (PARTITION BY product) AS product_avg_revenue,
              lag(revenue, 1) OVER w AS revenue_lag_1, lag(revenue, 7) OVER w AS revenue_lag_7,
              CASE WHEN row_number() OVER w >= 7 THEN avg(revenue) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) END AS revenue_rolling_mean_7,
              CASE WHEN row_number() OVER w >= 7 THEN stddev_samp(revenue) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) END AS revenue_rolling_std_7
        FROM u, q WHERE date IS NOT NULL WINDOW w AS (ORDER BY {", ".join(_PRE_COLS)}))
, done AS (SELECT *, CASE WHEN (SELECT bool_or(hit) FROM f) THEN hit ELSE true END AS is_successful_transaction FROM f)
SELECT {shown} FROM done
""")


@query("preprocess", _preprocess_sql())
def q_preprocess(spark, d):
    """The whole conforming pipeline on a raw upload: renamed headers, text
    dates, gaps in three columns and repeated rows."""
    v = sales_view(spark, d, _PRE_COLS, parts_first=True)
    gap = lambda c, n: F.when(F.col("order_id") % n != 0, F.col(c))
    v = v.withColumns({"quantity": gap("quantity", 50), "product": gap("product", 41), "price": gap("price", 67)})
    twice = F.when(F.col("order_id") % 10 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    v = v.select("*", F.explode(twice).alias("_copy"))
    raw = v.select(*[F.col(c).alias(RAW_HEADERS.get(c, c)) for c in _PRE_COLS]).withColumn("Tanggal", F.date_format("Tanggal", "dd/MM/yyyy"))
    return rnd(conform.preprocess(raw, order=_PRE_COLS), *_PRE_ROUND)


@query("drop_status_like", with_sales("""
SELECT date, category, revenue FROM sales
"""))
def q_drop_status_like(spark, d):
    """A product header holding order statuses is dropped (no proxies)."""
    v = view(spark, d, "date", "category", "status", "revenue")
    raw = v.select(F.col("date").alias("Tanggal"), F.col("status").alias("Nama Produk"),
                   F.col("category").alias("Kategori"), F.col("revenue").alias("Grand Total"))
    return conform.standardize_columns(raw, proxies=False)


@query("resolve_column", with_sales("""
SELECT region AS kota, round(sum(revenue), 4) AS revenue, count(revenue) AS transactions,
       round(sum(quantity), 4) AS quantity,
       round(sum(revenue) / (SELECT sum(revenue) FROM sales WHERE region IS NOT NULL) * 100, 6) AS revenue_share_pct,
       row_number() OVER (ORDER BY sum(revenue) DESC, region) AS rank
FROM sales WHERE region IS NOT NULL GROUP BY region
"""))
def q_resolve_column(spark, d):
    """Regional analysis on a table whose region column is named 'kota':
    the dimension is found through its candidate list."""
    from ..operators import dims
    v = view(spark, d, "region", "revenue", "quantity").withColumnRenamed("region", "kota")
    return rnd(dims.regional_analysis(v), ["revenue", "quantity"], ["revenue_share_pct"])
