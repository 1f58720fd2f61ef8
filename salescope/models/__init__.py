"""Forecasting, product segmentation and outlier detection on Spark ML."""
