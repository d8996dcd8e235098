"""Name -> plan registry used by ``__spark_entry__`` and ``bench.py``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mercato.plans import audit, eda, etl, files, forecasting, views
from mercato.plans import inventory as inv
from mercato.plans import kpi
from mercato.plans.ordering import ordered
from mercato.sources.fixture import Star, star_from_testdata

_STAR_QUERIES: dict[str, Callable[[Star], DataFrame]] = {
    "view_daily_sales": kpi.view_daily_sales,
    "view_daily_sales_revenue": kpi.view_daily_sales_revenue,
    "kpi01_totals": kpi.kpi01_totals,
    "kpi02_monthly_revenue": kpi.kpi02_monthly_revenue,
    "kpi03_yoy_revenue": kpi.kpi03_yoy_revenue,
    "kpi04_weekly_sales": kpi.kpi04_weekly_sales,
    "kpi05_top_units": kpi.kpi05_top_units,
    "kpi06_top_revenue": kpi.kpi06_top_revenue,
    "kpi07_bottom_revenue": kpi.kpi07_bottom_revenue,
    "kpi08_category_revenue": kpi.kpi08_category_revenue,
    "kpi09_department_revenue": kpi.kpi09_department_revenue,
    "kpi10_monthly_category": kpi.kpi10_monthly_category,
    "kpi11_store_revenue": kpi.kpi11_store_revenue,
    "kpi12_state_revenue": kpi.kpi12_state_revenue,
    "kpi13_store_ranking": kpi.kpi13_store_ranking,
    "kpi14_weekday": kpi.kpi14_weekday,
    "kpi15_month_seasonality": kpi.kpi15_month_seasonality,
    "kpi16_event_lift": kpi.kpi16_event_lift,
    "kpi17_snap_foods": kpi.kpi17_snap_foods,
    "kpi18_price_distribution": kpi.kpi18_price_distribution,
    "kpi19_price_volatility": kpi.kpi19_price_volatility,
    "kpi20_price_demand_corr": kpi.kpi20_price_demand_corr,
    "kpi21_rolling_demand": inv.kpi21_rolling_demand,
    "kpi22_reorder_alerts": inv.kpi22_reorder_alerts,
    "kpi23_abc_summary": inv.kpi23_abc_summary,
    "kpi24_risk_by_store_cat": inv.kpi24_risk_by_store_cat,
    "kpi25_demand_cv": kpi.kpi25_demand_cv,
    "kpi26_mom_category": kpi.kpi26_mom_category,
    "kpi27_cumulative_revenue": kpi.kpi27_cumulative_revenue,
    "kpi28_category_pairs": kpi.kpi28_category_pairs,
    "kpi29_zero_sales": kpi.kpi29_zero_sales,
    "bonus1_top5_per_store": kpi.bonus1_top5_per_store,
    "bonus2_demand_spikes": kpi.bonus2_demand_spikes,
    "bonus3_store_category_share": kpi.bonus3_store_category_share,
    "kpi30_financial_summary": inv.kpi30_financial_summary,
    "inv_abc": inv.inv_abc,
    "inv_abc_summary": inv.inv_abc_summary,
    "inv_recommendations": inv.inv_recommendations,
    "inv_metric_histogram": inv.inv_metric_histogram,
    "inv_stockout_risk": inv.inv_stockout_risk,
    "inv_top_risk": inv.inv_top_risk,
    "inv_financial_impact": inv.inv_financial_impact,
    "inv_executive_summary": inv.inv_executive_summary,
    "etl_calendar": etl.etl_calendar,
    "etl_melt": etl.etl_melt,
    "etl_daily_aggregated": etl.etl_daily_aggregated,
    "etl_enriched_daily": etl.etl_enriched_daily,
    "etl_top200_sample": etl.etl_top200_sample,
    "audit_report": audit.audit_report,
    "audit_nulls": audit.audit_nulls,
    "audit_events": audit.audit_events,
    "audit_constraints": audit.audit_constraints,
    "audit_cardinality": audit.audit_cardinality,
    "audit_distinct_values": audit.audit_distinct_values,
    "audit_price_summary": audit.audit_price_summary,
    "audit_histogram": audit.audit_histogram,
    "eda_daily": eda.eda_daily,
    "eda_weekly": eda.eda_weekly,
    "eda_monthly": eda.eda_monthly,
    "eda_peak_day": eda.eda_peak_day,
    "eda_category_share": eda.eda_category_share,
    "eda_category_monthly": eda.eda_category_monthly,
    "eda_store_perf": eda.eda_store_perf,
    "eda_state_revenue": eda.eda_state_revenue,
    "eda_weekday_mean": eda.eda_weekday_mean,
    "eda_month_mean": eda.eda_month_mean,
    "eda_decomposition": eda.eda_decomposition,
    "eda_top_events": eda.eda_top_events,
    "eda_snap_lift": eda.eda_snap_lift,
    "eda_yoy": eda.eda_yoy,
    "eda_store_month_pivot": eda.eda_store_month_pivot,
    "fc_holidays": forecasting.fc_holidays,
    "fc_metrics": forecasting.fc_metrics,
    "fc_category_90d": forecasting.fc_category_90d,
    "fc_store_30d": forecasting.fc_store_30d,
    "fc_components": forecasting.fc_components,
    "fc_model_metrics": forecasting.fc_model_metrics,
    "fc_dept_store": forecasting.fc_dept_store,
    "fc_checks": forecasting.fc_checks,
    "fc_linear": forecasting.fc_linear,
    "fc_item_store": forecasting.fc_item_store,
    "fc_item_store_30d": forecasting.fc_item_store_30d,
    "audit_derived_constraints": audit.audit_derived_constraints,
    "view_sql_state_year": views.view_sql_state_year,
    **files.QUERIES,
}


def _in_order(name: str, fn: Callable[[Star], DataFrame]) -> Callable[[Star], DataFrame]:
    def run(star: Star) -> DataFrame:
        return ordered(name, fn(star))
    return run


def star_queries() -> dict[str, Callable[[Star], DataFrame]]:
    return {name: _in_order(name, fn) for name, fn in _STAR_QUERIES.items()}


def bind(fn: Callable[[Star], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(star_from_testdata(spark, sf_dir))
    run.__name__ = getattr(fn, "__name__", "query")
    return run


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: bind(fn) for name, fn in star_queries().items()}
