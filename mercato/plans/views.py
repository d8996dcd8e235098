"""The named views, for SQL on a session."""

from __future__ import annotations

from pyspark.sql import DataFrame

from mercato.plans import kpi
from mercato.sources.fixture import Star


def register_views(star: Star) -> None:
    """The star's tables and both views as temporary views of the session."""
    tables = {"dim_calendar": star.calendar, "dim_product": star.product, "dim_store": star.store,
              "fact_sales": star.sales, "fact_prices": star.prices,
              "vw_daily_sales": kpi.view_daily_sales(star), "vw_daily_sales_revenue": kpi.view_daily_sales_revenue(star)}
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def view_sql_state_year(star: Star) -> DataFrame:
    """SQL over the revenue view: units, revenue and weekend share by state, category and year."""
    register_views(star)
    return star.sales.sparkSession.sql("""
        SELECT state_id, cat_id, year, SUM(units_sold) AS units, ROUND(SUM(revenue), 2) AS revenue,
               ROUND(100.0D * SUM(CASE WHEN is_weekend THEN units_sold ELSE 0 END) / NULLIF(SUM(units_sold), 0), 4) AS weekend_pct
        FROM vw_daily_sales_revenue GROUP BY state_id, cat_id, year""")
