"""Every registered analysis against its DuckDB oracle (the driver's gate)."""

import pytest

from tests.conftest import SF_SMALL
from salesdeck.registry import ANALYSES
from tests.oracle_check import check, duck_conn, norm

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def results(spark):
    return check(spark, SF_SMALL, sorted(ANALYSES), verbose=False)


@pytest.mark.parametrize("name", sorted(ANALYSES))
def test_matches_oracle(results, name):
    status, detail = results[name]
    assert status == "OK", f"{name}: {status} {detail}"


def test_every_analysis_is_registered_with_an_oracle():
    assert set(ANALYSES) <= set(entry.queries()) and set(ANALYSES) <= set(entry.oracle_sql())


# the reference's ORDER BY of every sorted analysis, down to the tie-break
ORDERS = {
    "rep_performance": "total_profit DESC, employeeNumber",
    "rep_profit_per_customer": "profit_per_customer DESC, employeeNumber",
    "org_hierarchy_filled": "reports_to, employee",
    "office_performance": "total_profit DESC, city",
    "monthly_revenue": "year, month",
    "monthly_revenue_period": "period",
    "product_line_by_year": "year, profit DESC, productLine",
    "product_line_pivot": "profit_2000 DESC NULLS LAST, productLine",
    "product_line_share": "profit DESC, productLine",
    "product_line_rank": "year, rank_desc, productLine",
    "monthly_by_year_series": "year",
    "monthly_margin_proxy": "period_label DESC",
    "seasonal_peak": "year",
    "year_to_date": "year",
    "fulfilment_time": "num_orders DESC, status NULLS FIRST",
    "customer_segments_all": "total_profit DESC, customerNumber",
    "customer_segments": "total_profit DESC, customerNumber",
    "segment_summary_all": "total_profit DESC, segment",
    "segment_summary": "total_profit DESC, segment",
    "segment_summary_ordered": "tier_order",
    "segment_share": "tier_order",
    "segment_filter_gold": "profit DESC, customer",
    "segment_filter_all": "profit DESC, customer",
    "table_page": "total_profit DESC, customerNumber",
    "top_k": "total_profit DESC, customerNumber",
    "dormant_customers": "days_since_order DESC, customerNumber",
    "dormant_with_segment": "days_since DESC, customerNumber",
    "low_stock": "low_stock_ratio DESC NULLS LAST, productCode",
    "product_performance": "revenue DESC NULLS LAST, productCode",
    "priority_restock": "low_stock_ratio DESC NULLS LAST, productCode",
}


@pytest.mark.parametrize("name", sorted(ORDERS))
def test_row_order_is_that_of_the_oracle(spark, name):
    got = entry.queries()[name](spark, SF_SMALL)
    cols = ", ".join(f'"{c}"' for c in got.columns)
    sql = f"SELECT {cols} FROM ({entry.oracle_sql()[name]}) ORDER BY {ORDERS[name]}"
    want = duck_conn(SF_SMALL).execute(sql).fetchall()
    assert [tuple(map(norm, r)) for r in got.collect()] == [tuple(map(norm, r)) for r in want]


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["year", "month", "num_orders", "revenue", "profit"]
    assert df.count() > 0


def test_result_columns_unique_and_public(spark):
    """The driver compares by sorted column name: names must be unique and ours."""
    for name, fn in entry.queries().items():
        cols = fn(spark, SF_SMALL).columns
        assert len(cols) == len(set(cols)) and not any(c.startswith("__") for c in cols), name
