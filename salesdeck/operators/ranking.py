"""Position of every row in a total order, without a single-task window.

``row_number().over(Window.orderBy(...))`` with no partition key moves every
row to one task.  ``global_row_number`` instead:

1. range-partitions by the sort key and sorts each partition (a distributed
   sort, as ``orderBy`` does);
2. numbers rows inside each partition from ``monotonically_increasing_id``,
   whose low 33 bits count the rows of a partition in their current order;
3. counts rows per partition (one row per partition), turns the counts into
   an exclusive prefix sum, and broadcasts that table -- its size is bounded
   by the number of partitions, not by the data -- back onto the rows.

The numbered rows are checkpointed into ``spark.checkpoint.dir`` (reliable
storage) so that step 3 and the final projection read the same partitions,
whatever AQE or a lost executor does to a recomputation.  The order must be
total (end it on a unique key); ties would otherwise be numbered arbitrarily.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesdeck.session import ensure_checkpoint_dir

_PID, _MID = "__pid", "__mid"


def global_row_number(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    # no partition count: AQE coalesces the ranges to the size of the input
    numbered = (df.repartitionByRange(*order)
                  .sortWithinPartitions(*order)
                  .withColumn(_PID, F.spark_partition_id())
                  .withColumn(_MID, F.monotonically_increasing_id())
                  .checkpoint(eager=True))
    counts = numbered.groupBy(_PID).agg(F.count(F.lit(1)).alias("__n"))
    # one row per partition: a global window here is bounded by the partition count
    before = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(_PID, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    local = F.col(_MID) - F.shiftleft(F.col(_PID).cast("long"), 33)
    return (numbered.join(F.broadcast(offsets), _PID)
                    .withColumn(name, F.col("__off") + local + F.lit(1))
                    .drop(_PID, _MID, "__off"))


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """First k rows of a total order (TakeOrderedAndProject: per-task top-k, then merge)."""
    return df.orderBy(*order).limit(k)


def page(df: DataFrame, order: list[Column], page_no: int, size: int) -> DataFrame:
    """Rows ``size*(page_no-1)+1 .. size*page_no`` of a total order."""
    return df.orderBy(*order).offset(size * (page_no - 1)).limit(size)


def present(df: DataFrame, params, *order) -> DataFrame:
    """The reference's ORDER BY, applied when a result is presented
    (``params.ordered``, the default).  A job that writes marts sets
    ``ordered=False``: a global sort is a full range shuffle, and readers of
    the written files do not see their order anyway."""
    return df.orderBy(*order) if params.ordered else df
