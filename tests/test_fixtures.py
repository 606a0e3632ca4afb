"""Edge cases of FIXTURES.md §4 on the hand-made micro fixture."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from salesdeck.plans import basics, customers, fulfilment, inventory, kpi, people
from salesdeck.sources import catalog
from tests.fixtures import PARAMS, micro_star


@pytest.fixture(scope="module")
def star(spark):
    return micro_star(spark)


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_rep_performance_inner_joins_drop_reps_and_customers(star):
    got = rows(people.rep_performance(star, PARAMS), "employeeNumber", "total_customers",
               "total_orders", "total_profit")
    # 22 has no customers, customer 107 has no rep, 109 never ordered: all dropped;
    # cancelled (108) and NULL-status (order 9) orders count in the SQL form
    assert got == [(31, 2, 2, 199999.99), (21, 3, 4, 90099.98), (32, 2, 2, 51000.0),
                   (23, 1, 1, 49999.99)]


def test_office_performance_and_na_territory(star):
    got = rows(people.office_performance(star, PARAMS), "city", "territory", "num_reps",
               "num_customers", "total_profit")
    assert got == [("Paris", "EMEA", 2, 4, 250999.99), ("San Francisco", "NA", 1, 3, 90099.98),
                   ("Auckland", "APAC", 1, 1, 49999.99)]


def test_hierarchy_root_first_and_filled_root_last(star):
    h = rows(people.org_hierarchy(star, PARAMS), "employee", "reports_to", "office")
    assert h[0] == ("Noor Castellan", None, "San Francisco")
    assert len(h) == 8
    # untrimmed city stays distinct from the trimmed one
    assert ("Pavel Quist", "Ilse Vandorn", "Auckland  ") in h
    assert ("Dara Whitlock", "Ilse Vandorn", "Auckland") in h
    f = rows(people.org_hierarchy_filled(star, PARAMS), "employee", "reports_to", "manager_title")
    assert f[-1] == ("Noor Castellan", "—", "—")


def test_role_class(star):
    got = dict(rows(people.hierarchy_role_class(star, PARAMS), "employeeNumber", "role_class"))
    assert got[10] == "president" and got[30] == "manager" and got[20] == "staff"
    assert got[31] == "staff"


def test_segment_boundaries_cancelled_excluded(star):
    got = rows(customers.customer_segments(star, PARAMS), "customerNumber", "total_profit", "segment")
    assert got == [(101, 100000.0, "Platinum"), (102, 99999.99, "Gold"), (103, 50000.0, "Gold"),
                   (104, 49999.99, "Silver"), (110, 49999.99, "Silver"), (105, 20000.0, "Silver"),
                   (106, 19999.99, "Bronze"), (107, -5.0, "Bronze")]


def test_segments_cancelled_included(star):
    got = dict(rows(customers.customer_segments_all(star, PARAMS), "customerNumber", "segment"))
    assert got[104] == "Gold"          # NULL-status order counts in the SQL form
    assert got[108] == "Bronze"        # only cancelled orders: present in the SQL form
    assert 109 not in got              # no orders


def test_segment_summary_and_missing_tier(star, spark):
    s = rows(customers.segment_summary(star, PARAMS), "segment", "num_customers", "total_profit",
             "avg_profit", "avg_orders")
    assert ("Platinum", 1, 100000.0, 100000.0, 1.0) in s
    assert ("Bronze", 2, 19994.99, 9997.5, 1.0) in s   # 9997.495 rounds half-up
    from salesdeck.params import Params
    p = Params(**{**PARAMS.__dict__, "tiers": (1e9, 5e8, 1e8)})
    o = rows(customers.segment_summary_ordered(star, p), "segment", "tier_order", "num_customers",
             "total_profit", "avg_profit")
    assert o[:3] == [("Platinum", 1, 0, 0.0, None), ("Gold", 2, 0, 0.0, None), ("Silver", 3, 0, 0.0, None)]
    assert o[3][0] == "Bronze" and o[3][2] == 8
    share = rows(customers.segment_share(star, p), "segment", "share_pct")
    assert share == [("Platinum", 0.0), ("Gold", 0.0), ("Silver", 0.0), ("Bronze", 100.0)]


def test_dormant_boundaries(star):
    d = rows(customers.dormant_customers(star, PARAMS), "customerNumber", "days_since_order",
             "last_order_date")
    ids = [r[0] for r in d]
    assert 104 not in ids                      # exactly 180 days: not dormant (strict >)
    assert (105, 181, dt.date(2004, 12, 2)) in d
    assert set(ids) == {101, 102, 103, 105, 107, 108}
    w = dict(rows(customers.dormant_with_segment(star, PARAMS), "customerNumber", "segment"))
    assert w[108] is None                      # only cancelled orders -> NULL tier
    c = dict(rows(customers.segment_code_lookup(star, PARAMS), "customerNumber", "colour"))
    assert c[108] == "#9aa0cc" and c[101] == "#ffd700"


def test_dormant_top15_label_truncation(star):
    t = rows(customers.dormant_top15(star, PARAMS), "customerName", "label")
    assert t[0] == ("Eta Very Long Customer Name Incorporated", "Eta Very Long Customer")
    lab = dict(rows(customers.fn_truncate_label(star, PARAMS), "customerNumber", "label_web"))
    assert lab[107] == "Eta Very Long Customer…"
    assert lab[101] == "Alpha Corp (France)"


def test_fulfilment_counts_cancelled_shipped_and_null_status(star):
    got = {r[0]: r[1:] for r in rows(fulfilment.fulfilment_time(star, PARAMS), "status",
                                          "num_orders", "avg_days_to_ship", "min_days", "max_days")}
    assert got == {"Shipped": (6, 3.5, 1.0, 7.0), "Resolved": (1, 2.0, 2.0, 2.0),
                   "Cancelled": (1, 2.0, 2.0, 2.0), None: (1, 1.0, 1.0, 1.0)}


def test_not_cancelled_drops_null_status(star):
    ids = {r[0] for r in rows(basics.filter_not_cancelled(star, PARAMS), "orderNumber")}
    assert 8 not in ids and 9 not in ids and 1 in ids


def test_kpi_strip(star):
    k = kpi.kpi_strip(star, PARAMS).collect()
    assert len(k) == 1
    r = k[0]
    assert (r.total_profit_m, r.top_rep, r.top_office, r.num_dormant) == (0.39, "Ines Okafor", "Paris", 6)
    # Platinum 100,000.00 of 389,999.96 excluding cancelled and NULL status
    assert r.platinum_share_pct == 25.64


def test_ties_break_on_key_and_paging(star):
    top = rows(customers.top_customers(star, PARAMS), "customerNumber")
    assert [t[0] for t in top][:5] == [101, 102, 104, 103, 110]  # SQL form: 104 = 50,099.99
    from salesdeck.params import Params
    p = Params(**{**PARAMS.__dict__, "page_size": 3})
    # cancelled excluded: 101, 102, 103 | 104, 110 (tie with 104, larger key), 105 | 106, 107
    assert [r[0] for r in rows(customers.table_page(star, p, page_no=2), "customerNumber")] == [104, 110, 105]
    assert [r[0] for r in rows(customers.table_page(star, p, page_no=3), "customerNumber")] == [106, 107]
    # filter + ascending sort: Silver = 104, 110, 105 -> ascending profit, key breaks the tie
    got = rows(customers.table_page(star, p, page_no=1, sort_col="total_profit", ascending=True,
                                    segment="Silver"), "customerNumber")
    assert [r[0] for r in got] == [105, 104, 110]


def test_rep_rank_is_a_total_order(star):
    r = rows(people.rep_rank(star, PARAMS), "employeeNumber", "rank")
    assert sorted(r, key=lambda x: x[1]) == [(31, 1), (21, 2), (32, 3), (23, 4)]


def test_low_stock_ranks_the_catalogue_and_restock_selects_by_rule(star):
    from dataclasses import replace
    low = rows(inventory.low_stock(star, PARAMS), "productCode", "low_stock_ratio")
    assert low == [("S12_1099", 1.5), ("S10_1678", 0.1)]
    # pace of the catalogue: 13 units on a stock of 102; S12 sells faster but earns little
    assert rows(inventory.priority_restock(star, PARAMS), "productCode") == []
    any_revenue = replace(PARAMS, restock_revenue=0.0)
    assert rows(inventory.priority_restock(star, any_revenue), "productCode") == [("S12_1099",)]
    anything = replace(any_revenue, restock_ratio=0.0)
    assert rows(inventory.priority_restock(star, anything), "productCode") == [("S12_1099",), ("S10_1678",)]
    perf = rows(inventory.product_performance(star, PARAMS), "productCode", "revenue")
    assert perf[-1] == ("S12_1099", 30.0)


def test_pivot_loses_no_year(star):
    from dataclasses import replace

    from salesdeck.plans import trends
    full = rows(trends.product_line_pivot(star, PARAMS), "productLine", "profit_2003", "profit_2004", "profit_2005",
                "profit_other_years")
    some = rows(trends.product_line_pivot(star, replace(PARAMS, pivot_years=(2004,))), "productLine", "profit_2004",
                "profit_other_years")
    total = dict(rows(trends.product_line_share(star, PARAMS), "productLine", "profit"))
    for got in (full, some):
        for line, *years in got:
            assert sum(y or 0 for y in years) == pytest.approx(total[line] / 1000)
    assert dict((r[0], r[2]) for r in some)["Motorcycles"] != 0


def test_parse_strict_and_lenient(spark):
    from tests.fixtures import ORDERS
    bad = list(ORDERS) + [(11, 101, "2004-02-30x", "garbage", "Shipped", "10.00")]
    st = micro_star(spark, orders=bad)
    o = st.orders_shipped.filter(F.col("orderNumber") == 11).select("shippedDate").collect()
    assert [r.shippedDate for r in o] == [None]  # lenient: bad ship date -> NULL -> not shipped
    with pytest.raises(Exception):
        st.orders.collect()                     # strict: bad order date is an error


def test_table_overview(star):
    got = dict((r[0], (r[1], r[2])) for r in rows(catalog.table_overview(star, PARAMS),
                                                    "table_name", "attribute_count", "row_count"))
    assert got["orders"] == (5, 10) and got["employees"] == (6, 8) and got["orderdetails"][1] == 11


def test_rep_profit_flag_and_labels(star):
    f = rows(people.rep_profit_flagged(star, PARAMS), "employeeNumber", "is_top", "profit_label")
    assert {x[0] for x in f if x[1]} == {31}
    assert (31, True, "$200k") in f
    lab = dict(rows(basics.fn_labels(star, PARAMS), "employeeNumber", "profit_label"))
    assert lab[21] == "$90,100"


def test_load_canonical_from_files(spark):
    """Canonical tables on disk read back to the same results."""
    import tempfile

    from salesdeck.sources.star import load_canonical
    from tests.fixtures import canonical_frames
    root = tempfile.mkdtemp(prefix="salesdeck-canon-")
    for name, df in canonical_frames(spark).items():
        df.write.parquet(f"{root}/{name}")
    disk = load_canonical(spark, root)
    mem = micro_star(spark)
    for fn in (people.rep_performance, customers.dormant_with_segment, fulfilment.fulfilment_time,
               people.office_performance):
        from collections import Counter
        assert Counter(map(tuple, fn(disk, PARAMS).collect())) == Counter(map(tuple, fn(mem, PARAMS).collect()))
    terr = {r.territory for r in disk.offices.collect()}
    assert "NA" in terr                      # the text NA is a value, not NULL


DATE_FORMS = {"text": "string", "text with time": "string", "date": "date", "timestamp": "timestamp",
              "timestamp_ntz": "timestamp_ntz"}


@pytest.mark.parametrize("form", DATE_FORMS)
def test_dates_of_every_encoding(spark, tmp_path, form):
    """DATE, timestamps and text with or without a time give the same results, from one scan of orders."""
    from salesdeck.sources.star import load_canonical
    from tests.fixtures import canonical_frames
    for name, df in canonical_frames(spark).items():
        if name == "orders":
            for c in ("orderDate", "shippedDate"):
                if form == "text with time":
                    df = df.withColumn(c, F.concat(c, F.lit(" 13:45:00" if c == "orderDate" else "T00:00:00")))
                else:
                    df = df.withColumn(c, F.col(c).cast(DATE_FORMS[form]))
        df.write.parquet(f"{tmp_path}/{name}")
    disk, mem = load_canonical(spark, str(tmp_path)), micro_star(spark)
    for fn in (fulfilment.fulfilment_time, customers.dormant_customers, fulfilment.fulfilment_outliers):
        assert sorted(map(repr, fn(disk, PARAMS).collect())) == sorted(map(repr, fn(mem, PARAMS).collect()))
    plan = fulfilment.fulfilment_time(disk, PARAMS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan
    if form == "date":
        assert "IsNotNull(shippedDate)" in plan.split("PushedFilters")[1]


def test_labels_on_marts(star):
    f = dict(rows(fulfilment.fulfilment_time(star, PARAMS), "status", "avg_label"))
    assert f["Shipped"] == "3.5 days"
    sh = dict(rows(customers.segment_share(star, PARAMS), "segment", "share_label"))
    assert sh["Silver"] == "37.5%" and sh["Platinum"] == "12.5%"


def test_null_status_rule(star):
    from salesdeck.params import Params
    sql = dict(rows(customers.customer_segments(star, PARAMS), "customerNumber", "segment"))
    pandas_rule = Params(**{**PARAMS.__dict__, "keep_null_status": True})
    pd_ = dict(rows(customers.customer_segments(star, pandas_rule), "customerNumber", "segment"))
    assert sql[104] == "Silver" and pd_[104] == "Gold"   # order 9 (NULL status, +100.00)
    assert 108 not in pd_                                 # cancelled stays out either way
