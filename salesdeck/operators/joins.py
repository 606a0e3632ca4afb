"""Join helper.

A broadcast hint is given only for a side whose size has a proven bound: the
4-row tier table here, nation and region and the offices made of them in
``sources.adapters``, the partition offsets in ``operators.ranking``.  Every
other join is left to the planner: ``spark.sql.autoBroadcastJoinThreshold`` at
plan time and AQE at run time turn a shuffle join into a broadcast join once
the *measured* size of a side is under the threshold; above it the join stays a
sort-merge join whose skewed partitions AQE splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_bounded(fact: DataFrame, dim: DataFrame, on, how: str = "inner") -> DataFrame:
    return fact.join(F.broadcast(dim), on, how)
