"""mercato: retail demand and inventory analytics on Spark DataFrames.

Layout
------
sources/    readers: the TPC-H-shaped test tables -> star schema adapter,
            M5-style CSV files, the wide daily-sales layout
functions/  column expressions (calendar keys, rounding rules, labels)
operators/  reusable DataFrame operators (price lookup, date spines,
            dense moments, melt, prefix sum, histogram, decomposition,
            grouped forecasting)
plans/      the named queries (KPIs, ETL, audit, EDA, inventory, forecast)
streaming/  incremental (Structured Streaming) form of the daily ETL
"""

from mercato.session import build_session, checkpoint_dir  # noqa: F401
