"""Conforming and cleaning: headers → canonical names, status-like probes,
proxy columns, date parsing, missing values, duplicates, revenue, status
flag, filters.

Plan-time decisions (which column maps where, which date format parses,
which numeric column becomes revenue) are taken from ``df.columns`` or from
probe jobs that return one aggregate row;
the data itself stays in lazy projections and filters.
"""

from __future__ import annotations

import datetime as _dt
from decimal import Decimal
from itertools import takewhile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..session import discard, store
from .common import has, require, to_numeric
from .ordered import forward_fill, joint_quantiles


# ---------------------------------------------------------------------------
# headers
# ---------------------------------------------------------------------------

def normalize_header(name: str) -> str:
    return name.lower().strip().replace(" ", "_")


def normalize_headers(df: DataFrame) -> DataFrame:
    """lower-case, strip, blanks → underscores (a rename, no data touched);
    headers that become equal are numbered (``name``, ``name_2``, …)."""
    names: list[str] = []
    for c in df.columns:
        names.append(_free_name(normalize_header(c), names))
    return df.toDF(*names)


def _free_name(name: str, taken: list[str]) -> str:
    n, out = 2, name
    while out in taken:
        out, n = f"{name}_{n}", n + 1
    return out


def header_mapping(columns: list[str]) -> dict[str, str]:
    """{normalised header: canonical name} following the vocabulary order.

    Pass 1 — exact: for every canonical name in priority order, the first
    header (in table order) equal to one of its variations.
    Pass 2 — substring: for canonical names still unmapped, the first free
    header that contains a variation of length ≥ 3 or is contained in one;
    reserved headers are never remapped, and product / customer refuse
    headers sharing a word with their blacklists.
    """
    cols = [normalize_header(c) for c in columns]
    mapping: dict[str, str] = {}
    done: set[str] = set()
    for std, variations in fixed.COLUMN_MAPPINGS.items():
        vs = {normalize_header(v) for v in variations}
        for c in cols:
            if c not in mapping and c in vs:
                mapping[c] = std
                done.add(std)
                break
    reserved = set(fixed.HARD_RESERVED_COLUMNS)
    product_block = set(fixed.PRODUCT_PARTIAL_BLACKLIST)
    customer_block = set(fixed.CUSTOMER_PARTIAL_BLACKLIST)
    for std, variations in fixed.COLUMN_MAPPINGS.items():
        if std in done:
            continue
        vs = [normalize_header(v) for v in variations]
        for c in cols:
            if c in mapping or c in reserved:
                continue
            words = set(c.split("_"))
            if std == "product" and words & product_block:
                continue
            if std == "customer" and words & customer_block:
                continue
            if any(len(v) >= 3 and (v in c or c in v) for v in vs):
                mapping[c] = std
                done.add(std)
                break
        # next canonical name
    return mapping


def standardize_columns(df: DataFrame, proxies: bool = True) -> DataFrame:
    """Normalise headers, rename to canonical names, drop a product/category
    column that holds statuses, then fill product/category/region proxies."""
    df = normalize_headers(df)
    mapping = header_mapping(df.columns)
    # a header that already is the canonical name of another one keeps its
    # values under ``<name>_raw``
    taken = set(mapping.values())
    aside = {c: _free_name(f"{c}_raw", df.columns) for c in df.columns if c in taken and c not in mapping}
    rename = {**mapping, **aside}
    df = df.toDF(*[rename.get(c, c) for c in df.columns])
    shares = status_shares(df, [c for c in ("product", "category") if c in df.columns])
    df = df.drop(*[c for c, share in shares.items() if share > fixed.STATUS_LIKE_SHARE])
    if proxies:
        df = proxy_columns(df, shares)
    return df


# ---------------------------------------------------------------------------
# status-like probes
# ---------------------------------------------------------------------------

def status_share(df: DataFrame, col: str) -> float:
    """Share of status words among all distinct lower-cased, trimmed values
    (one aggregate; 0 without values)."""
    return status_shares(df, [col])[col]


def status_shares(df: DataFrame, cols: list[str]) -> dict[str, float]:
    """``status_share`` of several columns by one pass over ``df``.  Its distinct
    rows of these columns come first: a plan that needs no more than them drops
    the lookups of all others."""
    if not cols:
        return {}
    values = df.select(*[F.lower(F.trim(F.col(c).cast("string"))).alias(f"v{i}") for i, c in enumerate(cols)]).distinct()
    each = values.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"v{i}").alias("v"))
                                             for i in range(len(cols))])).alias("x")).select("x.*")
    rows = each.where(F.col("v").isNotNull()).distinct().groupBy("i").agg(
        F.count("v").alias("n"), F.count_if(F.col("v").isin(fixed.STATUS_LIKE_VALUES)).alias("hits")).collect()
    found = {cols[r["i"]]: r["hits"] / r["n"] for r in rows}   # one row a column
    return {c: found.get(c, 0.0) for c in cols}


def is_status_like(df: DataFrame, col: str) -> bool:
    return status_share(df, col) > fixed.STATUS_LIKE_SHARE


def product_valid(df: DataFrame) -> bool:
    """The product column exists and its values are not mostly statuses."""
    return "product" in df.columns and not is_status_like(df, "product")


def proxy_columns(df: DataFrame, shares: dict[str, float] | None = None) -> DataFrame:
    """product ← category | channel (string, not status-like; else absent);
    category ← channel | courier (not status-like) else 'General';
    region ← store.  ``shares`` holds status shares that are known already."""
    types = dict(df.dtypes)
    known = dict(shares or {})

    def is_status_like(df: DataFrame, col: str) -> bool:
        if col not in known:
            known[col] = status_share(df, col)
        return known[col] > fixed.STATUS_LIKE_SHARE

    if "product" not in df.columns:
        for src in ("category", "channel"):
            if src in df.columns and types[src] == "string" and \
                    not is_status_like(df, src):
                df = df.withColumn("product", F.col(src).cast("string"))
                break
    if "category" not in df.columns:
        for src in ("channel", "courier"):
            if src in df.columns and not is_status_like(df, src):
                df = df.withColumn("category", F.col(src).cast("string"))
                break
        else:
            df = df.withColumn("category", F.lit("General"))
    if "region" not in df.columns and "store" in df.columns:
        df = df.withColumn("region", F.col("store").cast("string"))
    return df


# ---------------------------------------------------------------------------
# dates
# ---------------------------------------------------------------------------

def choose_date_format(df: DataFrame, col: str = "date") -> str | None:
    """First format that parses every non-null value.

    A text that does not parse costs far more than one that does, so each
    distinct text is tested once, and a format that fails on the least or the
    greatest text is out before the others are tested on every one."""
    texts = df.select(F.col(col).cast("string").alias("t")).where(F.col("t").isNotNull()).distinct().persist()
    try:
        ends = texts.agg(F.min("t").alias("a"), F.max("t").alias("b")).select(F.explode(F.array("a", "b")).alias("t"))
        open_ = _parsing_all(ends.where(F.col("t").isNotNull()), [*fixed.DATE_FORMATS, "generic"])
        open_ = _parsing_all(texts, open_)
    finally:
        texts.unpersist()
    return open_[0] if open_ else None


def _parsed(c: Column, fmt: str) -> Column:
    return c.try_cast("timestamp") if fmt == "generic" else F.try_to_timestamp(c, F.lit(fmt))


def _parsing_all(texts: DataFrame, formats: list[str]) -> list[str]:
    """Those of ``formats`` that parse every ``t``."""
    if not formats:
        return []
    row = texts.agg(*[F.count_if(_parsed(F.col("t"), fmt).isNull()).alias(f"f{i}") for i, fmt in enumerate(formats)]).first()
    return [fmt for i, fmt in enumerate(formats) if row[f"f{i}"] == 0]


def parse_dates(df: DataFrame, col: str = "date") -> DataFrame:
    """Parse a text date column with the first format that fits the whole
    column; otherwise a generic parse; otherwise leave the column as is."""
    if col not in df.columns:
        return df
    dtype = dict(df.dtypes)[col]
    if dtype.startswith("timestamp"):
        return df
    if dtype == "date":
        return df.withColumn(col, F.col(col).cast("timestamp_ntz"))
    fmt = choose_date_format(df, col)
    if fmt is None:
        return df
    return df.withColumn(col, _parsed(F.col(col).cast("string"), fmt).cast("timestamp_ntz"))


# ---------------------------------------------------------------------------
# missing values, duplicates
# ---------------------------------------------------------------------------

def column_mode(df: DataFrame, col: str):
    """Most frequent non-null value, the smallest one on ties.  Distributed:
    a count per value (partial aggregation) then a top-1."""
    row = (df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
             .orderBy(F.col("_n").desc(), F.col(col).asc()).limit(1).collect())
    return row[0][col] if row else None


_WHOLE = {"tinyint", "smallint", "int", "bigint"}


def _filled(col: str, value, dtype: str) -> Column:
    """``col`` with ``value`` for nulls; a whole-number column becomes double
    when the value has a fraction."""
    if value is None:
        return F.col(col)
    if dtype in _WHOLE and isinstance(value, (float, Decimal)) and value != int(value):
        return F.coalesce(F.col(col).cast("double"), F.lit(float(value)))
    return F.coalesce(F.col(col), F.lit(value).cast(dtype))


def fill_missing(df: DataFrame, strategy: dict[str, str] | None = None,
                 order: list | None = None, stored: bool = False) -> DataFrame:
    """Fill nulls per column with mean / median / mode / zero / ffill, or drop
    the rows (``drop``).  Defaults: quantity, price, revenue → median;
    product, category, region → mode.  mean/median skip non-numeric columns;
    the mode of an all-null column is 'Unknown'.  ``ffill`` needs ``order``.

    ``df`` is written once and read by the counts, the statistics and the result;
    ``stored`` tells that it comes straight from a written table."""
    plan = dict(fixed.DEFAULT_FILL_STRATEGY)
    plan.update(strategy or {})
    present = {c: s for c, s in plan.items() if c in df.columns}
    if not present:
        return df
    if not stored:
        df = store(df)
    null_counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in present]).first().asDict()
    types = dict(df.dtypes)
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    fills: dict[str, object] = {}
    ffill_cols: list[str] = []
    stat_cols = [c for c, s in present.items() if null_counts[c] and s in ("mean", "median", "mode")]
    # the statistics read only these columns
    base = df.select(*stat_cols)
    medians = [c for c in stat_cols if present[c] == "median" and c in numeric]
    if medians:
        fills |= {c: q[0] for c, q in joint_quantiles(base, {c: (c, [0.5]) for c in medians}).items()}
    means = [c for c in stat_cols if present[c] == "mean" and c in numeric]
    if means:
        fills |= base.agg(*[F.avg(c).alias(c) for c in means]).first().asDict()
    for c, s in present.items():
        if not null_counts[c]:
            continue
        if s == "mode":
            m = column_mode(base, c)
            fills[c] = "Unknown" if m is None else m
        elif s == "drop":
            df = df.where(F.col(c).isNotNull())
        elif s == "zero":
            fills[c] = 0
        elif s == "ffill":
            ffill_cols.append(c)
    if fills:
        df = df.withColumns({c: _filled(c, v, types[c]) for c, v in fills.items()})
    if ffill_cols:
        if not order:
            raise ValueError("ffill needs an explicit row order")
        df = forward_fill(df, order, ffill_cols)
    return df


def drop_duplicates(df: DataFrame, subset: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Full-row dedupe, or keep the first row per ``subset``: in ``order``, and
    by the other columns where that ties (or without an order), so that the row
    kept never depends on the partitioning.

    The subset form is an aggregate (``min_by`` over a struct), so a key
    holding a third of the rows is combined map-side instead of being
    sorted in one task as a window would be."""
    rest = [c for c in df.columns if c not in subset] if subset else []
    if not rest:
        return df.dropDuplicates(subset)
    row = F.struct(*[F.col(c) for c in rest])
    sortable = [c for c in rest if not isinstance(df.schema[c].dataType, (T.MapType, T.VariantType))]
    key = F.struct(*[F.col(c) for c in dict.fromkeys([*(order or []), *sortable])]) if order or sortable else F.lit(0)
    kept = df.groupBy(*subset).agg(F.min_by(row, key).alias("_row"))
    return kept.select(*subset, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


# ---------------------------------------------------------------------------
# status flag and revenue
# ---------------------------------------------------------------------------

def normalized_status(col: Column) -> Column:
    s = F.lower(F.trim(col.cast("string")))
    s = F.regexp_replace(s, r"[^a-z0-9\s]", " ")
    s = F.regexp_replace(s, r"\s+", " ")
    return F.trim(s)


def success_match(col: Column) -> Column:
    pattern = "|".join(fixed.SUCCESS_KEYWORDS)
    return F.coalesce(normalized_status(col).rlike(pattern), F.lit(False))


def status_flag(df: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """``is_successful_transaction``: status text contains a success word;
    all true when nothing matches anywhere or status/revenue is missing.
    Revenue is left unchanged.  ``base`` is a plainer table with the same
    statuses as ``df``, if there is one."""
    if not has(df, "status", "revenue"):
        return df.withColumn("is_successful_transaction", F.lit(True))
    hit = success_match(F.col("status"))
    # scalar subquery; the regex runs on the distinct statuses only (their
    # count is read because Spark drops a plain distinct below a maximum)
    each = (df if base is None else base).groupBy("status").agg(F.count(F.lit(1)).alias("_n"))
    any_hit = each.agg(F.max(F.when(F.col("_n") > 0, hit.cast("int")))).scalar()
    return df.withColumn("is_successful_transaction",
                         F.when(F.coalesce(any_hit, F.lit(0)) == 1, hit).otherwise(F.lit(True)))




def derive_revenue(df: DataFrame) -> DataFrame:
    """Numeric revenue: the revenue column coerced; else quantity × price;
    else the first numeric column named like a total; else the numeric
    column with the largest mean."""
    if "revenue" in df.columns:
        return df.withColumn("revenue", to_numeric(F.col("revenue")))
    if has(df, "quantity", "price"):
        return df.withColumn("revenue", to_numeric(F.col("quantity")) * to_numeric(F.col("price")))
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    for c in numeric:
        if any(k in c.lower() for k in fixed.REVENUE_KEYWORDS):
            return df.withColumn("revenue", to_numeric(F.col(c)))
    if numeric:
        means = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in numeric]).first().asDict()
        valid = [(v, i, c) for i, (c, v) in enumerate(means.items()) if v is not None]
        if valid:
            best = max(valid, key=lambda t: (t[0], -t[1]))[2]
            return df.withColumn("revenue", to_numeric(F.col(best)))
    return df


def drop_null_dates(df: DataFrame) -> DataFrame:
    return df.where(F.col("date").isNotNull()) if "date" in df.columns else df


# ---------------------------------------------------------------------------
# filters
# ---------------------------------------------------------------------------

def _as_date(x) -> _dt.date:
    return x if isinstance(x, _dt.date) else _dt.date.fromisoformat(str(x))


def filter_sales(df: DataFrame, start=None, end=None, categories=None, regions=None,
                 channels=None) -> DataFrame:
    """Inclusive date range ∧ category ∈ ∧ region ∈ ∧ channel ∈ (empty = no filter).
    The predicates are plain comparisons, so they reach the Parquet scan."""
    cond = F.lit(True)
    if start is not None and end is not None and "date" in df.columns:
        d = F.to_date(F.col("date"))
        cond = cond & d.between(F.lit(_as_date(start)), F.lit(_as_date(end)))
    for col, vals in (("category", categories), ("region", regions), ("channel", channels)):
        if vals and col in df.columns:
            cond = cond & F.col(col).isin(list(vals))
    return df.where(cond)


def last_n_days(df: DataFrame, n: int) -> DataFrame:
    """Rows with date > max(date) − n days; n = 0 keeps everything."""
    if not n:
        return df
    latest = df.agg(F.max("date")).scalar()
    return df.where(F.col("date") > latest - F.make_dt_interval(F.lit(n)))


# ---------------------------------------------------------------------------
# the whole conforming pipeline
# ---------------------------------------------------------------------------

def preprocess(df: DataFrame, order: list | None = None, fill_strategy: dict | None = None,
               features: bool = True) -> DataFrame:
    """conform → dates → missing → dedupe → revenue → status → drop null
    dates → features.  The upload is written once for the probes and the
    statistics, the distinct rows once for the features' ones; the rows are
    dealt by their order before they are made distinct, so that the lags need
    no second shuffle of them."""
    from .features import feature_engineering, lags_first

    upload = store(df)
    df = standardize_columns(upload)
    df = parse_dates(df)
    df = fill_missing(df, fill_strategy, order, stored=True)
    filled = df   # has the statuses of its distinct rows
    by = _unchanged(df, order or ["date"]) if features else []
    if by:
        df = df.repartitionByRange(*by)   # equal rows share a partition
    df = drop_duplicates(df)
    df = derive_revenue(df)
    df = status_flag(df, filled)
    df = drop_null_dates(df)
    if features:
        early = lags_first(df, order)
        df = feature_engineering(df if early else store(df), order=order, spread=bool(by))
        if early:
            discard(upload)
    return df


def _unchanged(df: DataFrame, order: list) -> list[str]:
    """The first columns of ``order``, as far as ``preprocess`` leaves them as
    they are after the duplicates are dropped; none if a single one is all that
    would deal the rows of a longer order."""
    made = ("revenue", "is_successful_transaction")
    by = list(takewhile(lambda c: isinstance(c, str) and c in df.columns and c not in made, order))
    return by if len(by) > 1 or len(by) == len(order) else []
