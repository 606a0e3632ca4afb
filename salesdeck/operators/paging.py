"""Pages of an ordered table that cost the same wherever they lie.

``LIMIT .. OFFSET ..`` makes every task keep offset + page rows and merges all
of them in one.  Two ways without an offset:

* ``next_page`` seeks past the last sort key of the page before (what a table
  view holds anyway): every task keeps one page of rows.
* ``store_pages`` writes the table once in its order with a ``position``, in
  folders of ``block`` rows; ``stored_page`` then reads any page by number: one
  folder by partition filter, and in it the few rows that the Parquet page
  index leaves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salesdeck.operators.ranking import global_row_number

POSITION, BLOCK = "position", "block"
#: Rows of a folder, and of a Parquet page, the least that a scan reads.
BLOCK_ROWS, PAGE_ROWS = 1_000_000, 1_000


def ordering(keys: Sequence[tuple[str, bool]]) -> list[Column]:
    """``keys`` are (column, ascending); NULL is the least value, as Spark sorts."""
    return [F.asc(k) if up else F.desc(k) for k, up in keys]


def after(keys: Sequence[tuple[str, bool]], last: Column) -> Column:
    """Whether a row comes after the row whose keys are the struct ``last``
    (nothing comes after a NULL struct, the last row of an empty page)."""
    late, same = F.lit(False), F.lit(True)
    for name, up in keys:
        mine, other = F.col(name), last[name]
        beyond = (mine > other) | (mine.isNotNull() & other.isNull()) if up \
            else (mine < other) | (mine.isNull() & other.isNotNull())
        late = late | (same & F.coalesce(beyond, F.lit(False)))
        same = same & mine.eqNullSafe(other)
    return last.isNotNull() & late


def next_page(df: DataFrame, keys: Sequence[tuple[str, bool]], size: int, last: Column | None = None) -> DataFrame:
    """The first ``size`` rows after the row whose keys are ``last`` (a struct;
    the first rows without one).  The last key must be unique."""
    rows = df if last is None else df.filter(after(keys, last))
    return rows.orderBy(*ordering(keys)).limit(size)


def last_key(page: DataFrame, keys: Sequence[tuple[str, bool]]) -> Column:
    """The keys of a page's last row, as a scalar subquery; NULL for an empty page."""
    back = [(k, not up) for k, up in keys]
    return page.orderBy(*ordering(back)).limit(1).select(F.struct(*[F.col(k) for k, _ in keys]).alias("last")).scalar()


def store_pages(df: DataFrame, keys: Sequence[tuple[str, bool]], path: str, block: int = BLOCK_ROWS) -> None:
    """Write ``df`` in the order of ``keys`` (the last one unique) with positions from 1."""
    numbered = global_row_number(df, ordering(keys), POSITION)
    numbered.withColumn(BLOCK, F.expr(f"({POSITION} - 1) div {int(block)}")) \
        .sortWithinPartitions(BLOCK, POSITION).write.mode("overwrite") \
        .option("parquet.page.row.count.limit", PAGE_ROWS).partitionBy(BLOCK).parquet(path)


def stored_page(spark: SparkSession, path: str, page_no: int, size: int, block: int = BLOCK_ROWS) -> DataFrame:
    """Rows ``size * (page_no - 1) + 1 .. size * page_no``, in order."""
    first, last = size * (page_no - 1) + 1, size * page_no
    return spark.read.parquet(path) \
        .filter(F.col(BLOCK).between((first - 1) // block, (last - 1) // block) & F.col(POSITION).between(first, last)) \
        .orderBy(POSITION).drop(BLOCK, POSITION)
