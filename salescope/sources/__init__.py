"""Readers, writers and the canonical view over the star-schema tables."""

from .tables import SALES_COLUMNS, sales_view, sales_view_sql  # noqa: F401
