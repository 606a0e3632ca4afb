"""Name -> analysis.  Every entry is ``f(star, params) -> DataFrame``."""

from __future__ import annotations

from functools import partial

from salesdeck.plans import basics, customers, distinct, documents, fulfilment, inventory, kpi, people, trends
from salesdeck.sources import catalog, views

ANALYSES = {
    # people
    "rep_performance": people.rep_performance,
    "rep_performance_bucketed": people.rep_performance_bucketed,
    "org_hierarchy": people.org_hierarchy,
    "org_hierarchy_filled": people.org_hierarchy_filled,
    "office_performance": people.office_performance,
    "hierarchy_role_class": people.hierarchy_role_class,
    "rep_profit_flagged": people.rep_profit_flagged,
    "rep_rank": people.rep_rank,
    "rep_profit_per_customer": people.rep_profit_per_customer,
    "office_lead_ratio": people.office_lead_ratio,
    # trends
    "monthly_revenue": trends.monthly_revenue,
    "monthly_refreshed": trends.monthly_refreshed,
    "monthly_revenue_period": trends.monthly_revenue_period,
    "product_line_by_year": trends.product_line_by_year,
    "product_line_pivot": trends.product_line_pivot,
    "monthly_by_year_series": trends.monthly_by_year_series,
    "monthly_margin_proxy": trends.monthly_margin_proxy,
    "seasonal_peak": trends.seasonal_peak,
    "product_line_share": trends.product_line_share,
    "product_line_rank": trends.product_line_rank,
    "year_to_date": trends.year_to_date,
    "distinct_years": trends.distinct_years,
    # fulfilment
    "fulfilment_time": fulfilment.fulfilment_time,
    "fulfilment_outliers": fulfilment.fulfilment_outliers,
    # customers
    "customer_segments_all": customers.customer_segments_all,
    "customer_segments": customers.customer_segments,
    "segment_summary_all": customers.segment_summary_all,
    "segment_summary": customers.segment_summary,
    "segment_summary_ordered": customers.segment_summary_ordered,
    "segment_share": customers.segment_share,
    "segment_concentration": customers.segment_concentration,
    "segment_filter_gold": partial(customers.segment_filter, segment="Gold"),
    "segment_filter_all": partial(customers.segment_filter, segment="All"),
    "segment_code_lookup": customers.segment_code_lookup,
    "case_segment": customers.case_segment,
    "table_page": customers.table_page,
    "table_page_stored": customers.table_page_stored,
    "top_k": customers.top_customers,
    "dormant_customers": customers.dormant_customers,
    "dormant_with_segment": customers.dormant_with_segment,
    "dormant_top15": customers.dormant_top15,
    "reengagement_target": customers.reengagement_target,
    "fn_truncate_label": customers.fn_truncate_label,
    # inventory / phase 1
    "low_stock": inventory.low_stock,
    "product_performance": inventory.product_performance,
    "priority_restock": inventory.priority_restock,
    "vip_customers": inventory.vip_customers,
    # key figures
    "kpi_strip": kpi.kpi_strip,
    "platinum_share": kpi.platinum_share,
    # catalogue, scans, sinks
    "table_overview": catalog.table_overview,
    "table_columns": catalog.table_columns,
    "table_statistics": catalog.table_statistics,
    "scan_table": catalog.scan_table,
    "scan_projected": catalog.scan_projected,
    "scan_filtered": catalog.scan_filtered,
    "parse_date_lenient": catalog.parse_date_lenient,
    "repaired_orders": catalog.repaired_orders,
    "rejected_orders": catalog.rejected_orders,
    "country_profit": views.country_profit,
    "rep_json_document": documents.rep_json_document,
    # single operators
    "filter_not_cancelled": basics.filter_not_cancelled,
    "filter_shipped": basics.filter_shipped,
    "join_inner": basics.join_inner,
    "join_left": basics.join_left,
    "agg_sum": basics.agg_sum,
    "agg_count": basics.agg_count,
    "agg_count_distinct": basics.agg_count_distinct,
    "customers_by_line": distinct.customers_by_line,
    "customers_by_year": distinct.customers_by_year,
    "agg_avg": basics.agg_avg,
    "agg_min_max": basics.agg_min_max,
    "fn_concat": basics.fn_concat,
    "fn_year_month": basics.fn_year_month,
    "fn_month_start": basics.fn_month_start,
    "fn_days_between": basics.fn_days_between,
    "fn_round": basics.fn_round,
    "fn_labels": basics.fn_labels,
}
