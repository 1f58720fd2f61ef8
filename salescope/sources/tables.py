"""Canonical sales view over the star-schema test tables.

Row grain: one lineitem.  The view is lazy; only the dimension lookups a
query needs are joined:

* part, supplier, customer and nation have unique keys, so a LEFT lookup
  never changes the row count — an unused lookup can be dropped exactly;
* lineitem.l_orderkey references orders (foreign key), so the inner join to
  orders is only planned when an order column (date, channel, status,
  customer, region) is requested.

Catalyst then prunes the scanned columns and pushes filters to Parquet.
Join strategy is left to Catalyst/AQE: the dimension sides are broadcast
only when their size statistics are under ``spark.sql.autoBroadcastJoinThreshold``
(a checked bound), otherwise they are sort-merge joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# Canonical column → (source tables needed, expression)
_NEEDS = {
    "date": {"orders"},
    "order_id": set(),
    "line_no": set(),
    "part_id": set(),
    "supplier_id": set(),
    "ship_date": set(),
    "product": {"part"},
    "category": {"part"},
    "cost": {"part"},
    "customer": {"orders", "customer"},
    "region": {"orders", "customer", "nation"},
    "store": {"supplier"},
    "channel": {"orders"},
    "status": {"orders"},
    "salesperson": set(),
    "quantity": set(),
    "price": set(),
    "revenue": set(),
    "discount": set(),
    "tax": set(),
}

SALES_COLUMNS = list(_NEEDS)

# Columns that order transactions deterministically (order_id + line_no is
# not unique in the test data).
ROW_ORDER = ["date", "order_id", "line_no", "part_id", "supplier_id", "ship_date", "revenue"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _expr(name: str) -> Column:
    c = F.col
    exprs = {
        "date": c("o_orderdate"),
        "order_id": c("l_orderkey"),
        "line_no": c("l_linenumber"),
        "part_id": c("l_partkey"),
        "supplier_id": c("l_suppkey"),
        "ship_date": c("l_shipdate"),
        "product": c("p_name"),
        "category": c("p_type"),
        "cost": c("p_retailprice"),
        "customer": c("c_name"),
        "region": c("n_name"),
        "store": c("s_name"),
        "channel": c("o_orderpriority"),
        "status": F.when(c("o_orderstatus") == "F", F.lit("Completed"))
                   .when(c("o_orderstatus") == "O", F.lit("Processing"))
                   .when(c("o_orderstatus") == "P", F.lit("Pending"))
                   .otherwise(c("o_orderstatus")),
        "salesperson": F.concat(F.lit("Rep "), c("l_suppkey").cast("string")),
        "quantity": c("l_quantity"),
        "price": F.try_divide(c("l_extendedprice"), c("l_quantity")),
        "revenue": c("l_extendedprice") * (F.lit(1.0) - c("l_discount")),
        "discount": c("l_extendedprice") * c("l_discount"),
        "tax": c("l_extendedprice") * c("l_tax"),
    }
    return exprs[name].alias(name)


def sales_view(spark: SparkSession, sf_dir: str, columns: list[str] | None = None, parts_first: bool = False) -> DataFrame:
    """Canonical sales rows (see module doc) restricted to ``columns``.  With
    ``parts_first`` lineitem meets part before orders: its lines are moved by
    part without the orders' columns, and come out by order."""
    cols = list(columns) if columns else list(SALES_COLUMNS)
    unknown = [x for x in cols if x not in _NEEDS]
    if unknown:
        raise ValueError(f"unknown sales columns: {unknown}")
    need: set[str] = set()
    for x in cols:
        need |= _NEEDS[x]

    df = read_table(spark, sf_dir, "lineitem")

    def with_parts(df: DataFrame) -> DataFrame:
        part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_retailprice")
        return df.join(part, df["l_partkey"] == part["p_partkey"], "left")

    if "part" in need and parts_first:
        df = with_parts(df)
    if "orders" in need:
        orders = read_table(spark, sf_dir, "orders")
        # an order's lookups come before its lines: fewer rows are moved
        if "customer" in need:
            cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
            orders = orders.join(cust, orders["o_custkey"] == cust["c_custkey"], "left")
        if "nation" in need:
            # nation has 25 rows by the schema definition: a proven size bound.
            nat = F.broadcast(read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
            orders = orders.join(nat, orders["c_nationkey"] == nat["n_nationkey"], "left")
        df = df.join(orders, df["l_orderkey"] == orders["o_orderkey"], "inner")
    if "part" in need and not parts_first:
        df = with_parts(df)
    if "supplier" in need:
        sup = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
        df = df.join(sup, df["l_suppkey"] == sup["s_suppkey"], "left")
    return df.select(*[_expr(x) for x in cols])


def sales_view_sql(columns: list[str] | None = None) -> str:
    """The same view as DuckDB/ANSI SQL (full joins; used by the oracles)."""
    cols = list(columns) if columns else list(SALES_COLUMNS)
    sql_expr = {
        "date": "o.o_orderdate",
        "order_id": "l.l_orderkey",
        "line_no": "l.l_linenumber",
        "part_id": "l.l_partkey",
        "supplier_id": "l.l_suppkey",
        "ship_date": "l.l_shipdate",
        "product": "p.p_name",
        "category": "p.p_type",
        "cost": "p.p_retailprice",
        "customer": "c.c_name",
        "region": "n.n_name",
        "store": "s.s_name",
        "channel": "o.o_orderpriority",
        "status": ("CASE o.o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Processing' "
                   "WHEN 'P' THEN 'Pending' ELSE o.o_orderstatus END"),
        "salesperson": "'Rep ' || CAST(l.l_suppkey AS VARCHAR)",
        "quantity": "l.l_quantity",
        "price": "CASE WHEN l.l_quantity = 0 THEN NULL ELSE l.l_extendedprice / l.l_quantity END",
        "revenue": "l.l_extendedprice * (1 - l.l_discount)",
        "discount": "l.l_extendedprice * l.l_discount",
        "tax": "l.l_extendedprice * l.l_tax",
    }
    select = ",\n    ".join(f"{sql_expr[x]} AS {x}" for x in cols)
    return (
        "SELECT\n    " + select + "\n"
        "FROM lineitem l\n"
        "JOIN orders o ON l.l_orderkey = o.o_orderkey\n"
        "LEFT JOIN part p ON l.l_partkey = p.p_partkey\n"
        "LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey\n"
        "LEFT JOIN customer c ON o.o_custkey = c.c_custkey\n"
        "LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey"
    )
