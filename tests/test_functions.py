"""Column functions: exact money rounding, tiers, labels."""

from pyspark.sql import functions as F

from salesdeck.functions.labels import grouped_label, thousands_label, truncate_ellipsis
from salesdeck.functions.measures import tier
from salesdeck.functions.money import cents_ratio, div_half_up, dollars, round_half_up


def test_div_half_up_exact_ties(spark):
    df = spark.createDataFrame([(1172461710, 12), (-5, 2), (5, 2), (4, 3), (10**17 + 5, 10), (0, 7)],
                               "c long, n long")
    got = [r[0] for r in df.select(div_half_up("c", "n")).collect()]
    assert got == [97705143, -3, 3, 1, 10**16 + 1, 0]
    # the double route rounds the same tie down: 11,724,617.10 / 12 = 977,051.425
    r = df.limit(1).select(round_half_up(dollars("c") / F.col("n"), 2).alias("d"),
                           cents_ratio("c", "n", 2).alias("e"), cents_ratio("c", "n", 1).alias("f"),
                           cents_ratio("c", "n", 0).alias("g")).first()
    assert (r.d, r.e, r.f, r.g) == (977051.42, 977051.43, 977051.4, 977051.0)


def test_tier_boundaries_in_cents(spark):
    df = spark.createDataFrame([(10000000,), (9999999,), (5000000,), (4999999,), (2000000,),
                                (1999999,), (None,), (-1,)], "p long")
    got = [r[0] for r in df.select(tier("p", (100_000, 50_000, 20_000))).collect()]
    assert got == ["Platinum", "Gold", "Gold", "Silver", "Silver", "Bronze", "Bronze", "Bronze"]


def test_labels(spark):
    df = spark.createDataFrame([(505499.99, "Mini Gifts Distributors Ltd."), (-1500.5, "Alpha")],
                               "v double, s string")
    got = df.select(thousands_label(F.col("v")), grouped_label(F.col("v")),
                    truncate_ellipsis(F.col("s"), 22)).collect()
    assert [tuple(r) for r in got] == [("$505k", "$505,500", "Mini Gifts Distributor…"),
                                       ("$-2k", "$-1,501", "Alpha")]


def test_published_golden_figures(spark):
    # published tier totals -> Platinum share of profit (app formula): 14.58 %
    seg = spark.createDataFrame([("Bronze", 23326093), ("Gold", 86655029), ("Platinum", 54409188),
                                 ("Silver", 208760887)], "segment string, c long")
    share = seg.agg(round_half_up(F.sum(F.when(F.col("segment") == "Platinum", F.col("c"))) * 100.0
                                  / F.sum("c"), 2)).first()[0]
    assert share == 14.58
    # the two published Platinum customers sum to the published Platinum total
    two = spark.createDataFrame([(30732249,), (23676939,)], "c long")
    assert two.agg(dollars(F.sum("c"))).first()[0] == 544091.88
    assert [r[0] for r in two.select(tier("c", (100_000, 50_000, 20_000))).collect()] == ["Platinum"] * 2


def test_api_helpers(spark):
    import datetime as dt

    from salesdeck.api import dormant, filter_segment, segment
    df = spark.createDataFrame([(1, 100000.0), (2, 99999.99), (3, 20000.0)], "k long, total_profit double")
    s = segment(df, (100_000, 50_000, 20_000))
    assert [r.segment for r in s.orderBy("k").collect()] == ["Platinum", "Gold", "Silver"]
    assert filter_segment(s, "Gold").count() == 1 and filter_segment(s, "All").count() == 3
    o = spark.createDataFrame([(1, dt.date(2004, 12, 3)), (2, dt.date(2004, 12, 2)), (2, dt.date(2003, 1, 1))],
                              "customerNumber long, orderDate date")
    d = dormant(o, dt.date(2005, 6, 1), 180).collect()
    assert [(r.customerNumber, r.days_since) for r in d] == [(2, 181)]


def test_clean_option_trims_dimension_text(spark):
    from salesdeck.plans import people
    from salesdeck.sources.star import cleaned
    from tests.fixtures import PARAMS, micro_star
    st = cleaned(micro_star(spark))
    offices = {r.office for r in people.org_hierarchy(st, PARAMS).collect()}
    assert "Auckland  " not in offices and "Auckland" in offices
