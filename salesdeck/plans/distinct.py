"""Distinct customers that add up.

A count of distinct customers can't be summed over years or product lines.  A
bitmap of them can be merged: the mart holds, for every product line and year,
the customers as bitmaps of 32,768 consecutive numbers each, so any roll-up
is a union (``bitmap_or_agg``) and a count of bits, exact and without going
back to the order lines.  A customer or a product line of any share of the
rows sets bits in the same few bitmaps on the map side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesdeck.operators.ranking import present
from salesdeck.params import DEFAULT, Params
from salesdeck.plans.facts import _memo, orders_in_scope
from salesdeck.sources.star import Star


def as_bitmaps(df: DataFrame, key: str, *by: str) -> DataFrame:
    """(``by``, ``bucket``, ``members``): the distinct integer ``key``s of each group."""
    return df.groupBy(*by, F.bitmap_bucket_number(key).alias("bucket")) \
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(key)).alias("members"))


def count_members(bitmaps: DataFrame, *by: str, name: str = "num_customers") -> DataFrame:
    """Distinct members per ``by``: bitmaps of a bucket are united, then counted."""
    united = bitmaps.groupBy(*by, "bucket").agg(F.bitmap_or_agg("members").alias("members"))
    return united.groupBy(*by).agg(F.sum(F.bitmap_count("members")).alias(name))


def customer_bitmaps(star: Star, params: Params = DEFAULT) -> DataFrame:
    """The mart: (``productLine``, ``year``, ``bucket``, ``members``), cancelled orders excluded."""
    return _memo(star, "customer_bitmaps", lambda: _customer_bitmaps(star, params))


def _customer_bitmaps(star: Star, params: Params) -> DataFrame:
    o = orders_in_scope(star, params, False).filter("customerNumber is not null") \
        .select("orderNumber", "customerNumber", F.date_format("orderDate", "yyyy").alias("year"))
    # a product is a row for each year and customer before its line is looked up
    bought = star.orderdetails.select("orderNumber", "productCode").join(o, "orderNumber") \
        .select("year", "customerNumber", "productCode").distinct()
    lines = bought.join(star.products.select("productCode", "productLine"), "productCode")
    return as_bitmaps(lines, "customerNumber", "productLine", "year")


def customers_by_line(star: Star, params: Params = DEFAULT) -> DataFrame:
    """Distinct customers of every product line, over all years of the mart."""
    return count_members(customer_bitmaps(star, params), "productLine") \
        .transform(present, params, F.desc("num_customers"), "productLine")


def customers_by_year(star: Star, params: Params = DEFAULT) -> DataFrame:
    """Distinct customers of every year, over all product lines of the mart, and
    how many of them had bought in the year before."""
    m = customer_bitmaps(star, params).groupBy("year", "bucket").agg(F.bitmap_or_agg("members").alias("members"))
    before = m.select((F.col("year").cast("int") + 1).cast("string").alias("year"), "bucket", F.col("members").alias("earlier"))
    # in both: |a| + |b| - |a or b|, bucket by bucket
    both = m.join(before, ["year", "bucket"], "left").select(
        "year", "bucket", F.bitmap_count("members").alias("now"), F.coalesce(F.bitmap_count("earlier"), F.lit(0)).alias("then"),
        F.explode(F.array("members", "earlier")).alias("members"))
    united = both.filter("members is not null").groupBy("year", "bucket").agg(
        F.max("now").alias("now"), F.max("then").alias("then"), F.bitmap_count(F.bitmap_or_agg("members")).alias("either"))
    return united.groupBy("year").agg(
        F.sum("now").alias("num_customers"), F.sum(F.col("now") + F.col("then") - F.col("either")).alias("num_returning")) \
        .transform(present, params, "year")
