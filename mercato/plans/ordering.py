"""Row order of the ordered queries.

A ``-`` in front means descending. Nulls come first in descending and last in ascending
order (rule R4). Keys after the stated ones break ties, so the order is total. Frames with a
row per series or day are sorted by range partitions; the others have few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = {
    "kpi02_monthly_revenue": "year month",
    "kpi03_yoy_revenue": "year",
    "kpi04_weekly_sales": "wm_yr_wk",
    "kpi05_top_units": "-total_units_sold product_id",
    "kpi06_top_revenue": "-total_revenue product_id",
    "kpi07_bottom_revenue": "total_revenue product_id",
    "kpi08_category_revenue": "-total_revenue cat_id",
    "kpi09_department_revenue": "cat_id -total_revenue dept_id",
    "kpi10_monthly_category": "year month cat_id",
    "kpi11_store_revenue": "-total_revenue store_id",
    "kpi12_state_revenue": "-total_revenue state_id",
    "kpi13_store_ranking": "revenue_rank store_id",
    "kpi14_weekday": "wday",
    "kpi15_month_seasonality": "month",
    "kpi16_event_lift": "-pct_lift_vs_normal event_name event_type",
    "kpi17_snap_foods": "state_id is_snap_day",
    "kpi18_price_distribution": "-avg_price cat_id",
    "kpi19_price_volatility": "-num_price_changes product_id store_id",
    "kpi21_rolling_demand": "product_id store_id date",
    "kpi22_reorder_alerts": "current_stock_proxy product_id store_id",
    "kpi23_abc_summary": "abc_class",
    "kpi24_risk_by_store_cat": "-high_risk_skus store_id cat_id",
    "kpi25_demand_cv": "-cv_pct product_id store_id",
    "kpi26_mom_category": "cat_id month",
    "kpi27_cumulative_revenue": "date",
    "kpi28_category_pairs": "-co_occurrence_days category_1 category_2",
    "kpi29_zero_sales": "-zero_sale_pct product_id store_id",
    "kpi30_financial_summary": "-estimated_annual_holding_cost_usd cat_id",
    "bonus1_top5_per_store": "store_id rank_in_store product_id",
    "bonus3_store_category_share": "-pct_of_total_revenue store_id cat_id",
}


def order_keys(name: str) -> list[Column]:
    return [F.desc_nulls_first(k[1:]) if k[0] == "-" else F.asc_nulls_last(k) for k in ORDER[name].split()]


def ordered(name: str, df: DataFrame) -> DataFrame:
    return df.orderBy(*order_keys(name)) if name in ORDER else df
