"""The parameterised building blocks as plain functions on DataFrames.

The reference hard-codes these literals in its SQL (tier thresholds, the
"end of data" date, the 180-day window) and its app filters a computed table
by a dropdown value.  Here they take DataFrames and parameters, so they run
on any compatible frame, e.g. a mart already written to storage.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesdeck.functions.measures import tier, whole_days_between


def segment(df: DataFrame, thresholds: tuple[float, float, float],
            profit_col: str = "total_profit", out: str = "segment") -> DataFrame:
    """Add the tier of a profit column given in dollars (exact: compared in cents)."""
    cents = F.rint(F.col(profit_col) * F.lit(100.0)).cast("long")
    return df.withColumn(out, tier(cents, thresholds))


def dormant(orders: DataFrame, as_of: dt.date, days: int,
            key: str = "customerNumber", date_col: str = "orderDate") -> DataFrame:
    """Keys whose last order is more than ``days`` before ``as_of``
    (per-key aggregate: partial aggregation map-side, one row per key)."""
    last = orders.groupBy(key).agg(F.max(date_col).alias("last_order_date"))
    since = whole_days_between(F.lit(as_of), F.col("last_order_date"))
    return last.withColumn("days_since", since).filter(F.col("days_since") > days)


def filter_segment(df: DataFrame, name: str, col: str = "segment") -> DataFrame:
    """The interactive tier filter: ``"All"`` keeps every row."""
    return df if name == "All" else df.filter(F.col(col) == F.lit(name))
