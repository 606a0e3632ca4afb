"""Pages by seek and by stored position equal pages by offset, and read one page."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from salesdeck.operators.paging import BLOCK, last_key, next_page, ordering, store_pages, stored_page
from salesdeck.params import DEFAULT, Params
from salesdeck.plans.customers import table_page
from salesdeck.sources.star import load_star
from salesdeck.sources.stored import scratch, shipped, shipped_between, store_orders
from tests.conftest import SF_MID, SF_SMALL

RNG = random.Random(3)
ROWS = [(i, RNG.choice([None, 1.5, 2.5, -0.0, 7.0]), RNG.choice([None, "a", "b"])) for i in range(230)]


def offset_page(df, keys, number, size):
    return df.orderBy(*ordering(keys)).offset(size * (number - 1)).limit(size).collect()


@pytest.mark.parametrize("keys", [[("x", True), ("id", True)], [("x", False), ("s", True), ("id", False)], [("s", False), ("id", True)]])
def test_seek_walks_all_pages(spark, keys):
    df = spark.createDataFrame(ROWS, "id long, x double, s string")
    last = None
    for number in range(1, 27):
        page = next_page(df, keys, 10, last).collect()
        assert page == offset_page(df, keys, number, 10), number
        if page:
            last = F.struct(*[F.lit(page[-1][k]).cast(df.schema[k].dataType).alias(k) for k, _ in keys])
    assert page == []


def test_last_key_of_a_page(spark):
    df = spark.createDataFrame(ROWS, "id long, x double, s string")
    keys = [("x", False), ("id", True)]
    first = next_page(df, keys, 7)
    assert next_page(df, keys, 7, last_key(first, keys)).collect() == offset_page(df, keys, 2, 7)
    assert next_page(df, keys, 7, last_key(df.limit(0), keys)).collect() == []


def test_seek_keeps_a_page_per_task(spark):
    df = spark.createDataFrame(ROWS, "id long, x double, s string")
    keys = [("id", True)]
    p = next_page(df, keys, 10, F.struct(F.lit(150).alias("id")))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=10," in p and "offset" not in p


def rows_read(df):
    """(rows, files) that the scan of an executed plan put out."""
    df.collect()
    todo, rows = [df._jdf.queryExecution().executedPlan()], None
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif name == "FileSourceScanExec":
            rows = node.metrics().apply("numOutputRows").value(), node.metrics().apply("numFiles").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return rows


def test_a_stored_page_reads_little_wherever_it_lies(spark, tmp_path):
    df = spark.range(60_000).select(F.pmod(F.col("id") * 7919, F.lit(60_000)).alias("k"), F.xxhash64("id").alias("v"))
    store_pages(df, [("k", False)], f"{tmp_path}/p", block=20_000)
    for number in (1, 1000, 1001, 2500, 3000):
        page = stored_page(spark, f"{tmp_path}/p", number, 20, block=20_000)
        p = page._jdf.queryExecution().executedPlan().toString()
        assert f"PartitionFilters: [isnotnull({BLOCK}" in p and "GreaterThanOrEqual(position," in p
        assert [r.k for r in page.collect()] == [59_999 - i for i in range(20 * (number - 1), 20 * number)]
        rows, files = rows_read(stored_page(spark, f"{tmp_path}/p", number, 20, block=20_000))
        assert rows <= 2_000 and files <= 3, number  # of 60,000 rows
    assert stored_page(spark, f"{tmp_path}/p", 3001, 20, block=20_000).collect() == []


def test_customer_pages_equal_the_offset_form(spark, tmp_path):
    star = load_star(spark, SF_MID)
    whole = table_page(star, Params(page_size=10_000), 1).collect()
    assert len(whole) > 1000
    keys = [("total_profit", False), ("customerNumber", True)]
    store_pages(table_page(star, Params(page_size=10_000), 1), keys, f"{tmp_path}/p")
    for number in (1, 2, 40, len(whole) // 20 + 1, 1_000_000):
        want = whole[20 * (number - 1):20 * number]
        assert stored_page(spark, f"{tmp_path}/p", number, 20).collect() == want
        if 1 < number < 100:
            assert table_page(star, DEFAULT, last=whole[20 * (number - 1) - 1]).collect() == want
    assert table_page(star, DEFAULT, 4).collect() == whole[60:80]
    up = table_page(star, DEFAULT, 2, sort_col="customerName", ascending=True, segment="Gold").collect()
    gold = sorted((r for r in whole if r.segment == "Gold"), key=lambda r: (r.customerName, r.customerNumber))
    assert up == gold[20:40]


def test_stored_orders_prune_by_ship_year(spark):
    star = load_star(spark, SF_SMALL)
    orders = store_orders(star, scratch(spark, "orders"))
    assert sorted(shipped(orders).drop("shippedYear").collect()) == sorted(star.orders_shipped.filter("shippedDate is not null").collect())
    assert orders.count() == star.orders.count()
    some = shipped_between(orders, dt.date(1996, 11, 1), dt.date(1997, 2, 1))
    want = star.orders_shipped.filter("shippedDate between date'1996-11-01' and date'1997-02-01'")
    assert sorted(some.drop("shippedYear").collect()) == sorted(want.collect()) and some.count() > 0
    files = len({x.split("shippedYear=")[1].split("/")[0] for x in orders.inputFiles()})
    assert files > 3 and rows_read(some)[0] < orders.count() / 2
