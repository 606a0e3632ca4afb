"""Order fulfilment time (ship date - order date)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesdeck.functions.labels import days_label
from salesdeck.functions.measures import days_between
from salesdeck.functions.money import round_half_up, safe_ratio
from salesdeck.operators.ranking import present
from salesdeck.params import DEFAULT, Params
from salesdeck.sources.star import Star


def _shipped(star: Star) -> DataFrame:
    o = star.orders_shipped.filter(F.col("shippedDate").isNotNull())
    return o.select("orderNumber", "status", "orderDate", "shippedDate",
                    days_between("shippedDate", "orderDate").alias("days_to_ship"))


def fulfilment_time(star: Star, params: Params = DEFAULT) -> DataFrame:
    """Per status (NULL status is a group): count, average (1 dp), min, max days.
    Cancelled orders that shipped are counted."""
    s = _shipped(star)
    g = s.groupBy("status").agg(
        F.count(F.lit(1)).alias("num_orders"),
        round_half_up(F.avg("days_to_ship"), 1).alias("avg_days_to_ship"),
        F.min("days_to_ship").alias("min_days"),
        F.max("days_to_ship").alias("max_days"))
    return g.withColumn("avg_label", days_label(F.col("avg_days_to_ship"))) \
            .transform(present, params, F.desc("num_orders"), "status")


def status_averages(shipped: DataFrame, most: int) -> Column:
    """The mean days to ship of the row's own status, as a column.

    The means (one row per status) become one map value, read as a scalar
    subquery; so no order is ever dealt by its status, of which a third of all
    orders may share one.  Keys carry a mark, so that NULL is a key as well.
    The statuses of the order cycle are a closed list; a column with over
    ``most`` of them is not a status, and raises instead of growing the map."""
    key = F.coalesce(F.concat(F.lit("="), "status"), F.lit(""))
    per = shipped.groupBy("status").agg(F.avg("days_to_ship").alias("mean"))
    means = per.agg(F.when(F.count("*") > most, F.raise_error(F.lit(f"over {most} order statuses")))
                    .otherwise(F.map_from_entries(F.collect_list(F.struct(key, "mean")))).alias("means")).scalar()
    return F.try_element_at(means, key)


def fulfilment_outliers(star: Star, params: Params = DEFAULT) -> DataFrame:
    """Shipped orders whose time to ship exceeds ``outlier_factor`` times the
    average of their status (orders without a status: of each other)."""
    s = _shipped(star)
    j = s.withColumn("status_avg", status_averages(s, params.most_statuses))
    return j.filter(F.col("days_to_ship") > F.lit(params.outlier_factor) * F.col("status_avg")).select(
        "orderNumber", "status", "days_to_ship",
        round_half_up("status_avg", 2).alias("status_avg_days"),
        round_half_up(safe_ratio(F.col("days_to_ship"), F.col("status_avg")), 2).alias("ratio_to_avg"))
