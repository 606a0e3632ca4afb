
import pytest
from pyspark.sql import functions as F

from salesdeck.params import DEFAULT
from salesdeck.plans import basics, customers, fulfilment, kpi, people, trends
from salesdeck.sources.star import load_star
from tests.conftest import SF_MID, SF_SMALL


@pytest.fixture(scope="module", params=[SF_SMALL, SF_MID])
def star(spark, request):
    return load_star(spark, request.param)


def total(df, col):
    return df.agg(F.sum(col)).first()[0]


def test_rep_total_equals_office_total(star):
    reps = people.rep_performance(star, DEFAULT)
    offs = people.office_performance(star, DEFAULT)
    assert total(reps, "total_profit") == pytest.approx(total(offs, "total_profit"), abs=0.005)
    assert total(reps, "total_customers") == total(offs, "num_customers")
    assert reps.count() == total(offs, "num_reps")


def test_cancelled_excluded_totals_agree(star):
    pl = total(trends.product_line_by_year(star, DEFAULT), "profit")
    cs = total(customers.customer_segments(star, DEFAULT), "total_profit")
    ss = total(customers.segment_summary(star, DEFAULT), "total_profit")
    mo = total(trends.monthly_revenue(star, DEFAULT), "profit")
    assert pl == pytest.approx(cs, abs=0.01) and cs == pytest.approx(ss, abs=0.01)
    assert mo == pytest.approx(pl, abs=0.01)


def test_cancelled_in_minus_out_is_cancelled_profit(star):
    all_ = total(customers.segment_summary_all(star, DEFAULT), "total_profit")
    out = total(customers.segment_summary(star, DEFAULT), "total_profit")
    canc = basics.agg_sum(star, DEFAULT).filter(F.col("status") == DEFAULT.cancelled).first()["profit"]
    assert all_ - out == pytest.approx(canc, abs=0.01)


def test_regrouping_segments_gives_summary(star):
    seg = customers.customer_segments(star, DEFAULT).groupBy("segment").agg(
        F.count(F.lit(1)).alias("n"), F.sum("total_profit").alias("t"))
    mine = {r.segment: (r.n, round(r.t, 2)) for r in seg.collect()}
    summ = {r.segment: (r.num_customers, round(r.total_profit, 2))
            for r in customers.segment_summary(star, DEFAULT).collect()}
    assert mine == summ


def test_platinum_share_formula(star):
    s = {r.segment: r.total_profit for r in customers.segment_summary(star, DEFAULT).collect()}
    want = round(s.get("Platinum", 0.0) / sum(s.values()) * 100, 2)
    got = kpi.platinum_share(star, DEFAULT).first()["platinum_share_pct"]
    assert got == pytest.approx(want, abs=0.011)


def test_fulfilment_counts_equal_shipped_orders(star):
    n = total(fulfilment.fulfilment_time(star, DEFAULT), "num_orders")
    assert n == star.shipments.count()


def test_distinct_orders_over_customers(star):
    a = total(customers.customer_segments_all(star, DEFAULT), "total_orders")
    b = star.orders.join(star.orderdetails.select("orderNumber").distinct(), "orderNumber") \
                   .join(star.customers.select("customerNumber"), "customerNumber").count()
    assert a == b
