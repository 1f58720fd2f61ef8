"""salescope — sales analytics as Spark DataFrame operators.

Transaction tables with arbitrary headers are conformed to one canonical
sales schema and answered with lazy DataFrame operators (KPIs, growth,
rankings, Pareto, RFM, profitability, forecasting, segmentation, outliers).
"""

__version__ = "0.1.0"
