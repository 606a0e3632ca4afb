"""Writers for analysis results.

Row records go out as JSON lines or Parquet, written by the executors (no
result passes through the driver).  ``column_pages`` builds the web page's
column-oriented document ({"x": [...], "y": [...]}) in pages of a fixed size,
so it may hold a table of any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_rows(df: DataFrame, path: str, fmt: str = "json", partition_by: list[str] | None = None,
               mode: str = "overwrite") -> None:
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def column_pages(df: DataFrame, position: str, fields: dict[str, str], size: int) -> DataFrame:
    """One row per ``size`` positions (1, 2, ...): ``page`` and a list for each
    field, in order of position.  A group never exceeds ``size`` rows."""
    rows = df.select(F.expr(f"({position} - 1) div {int(size)}").alias("page"),
                     F.struct(position, *[F.col(c).alias(k) for k, c in fields.items()]).alias("row"))
    pages = rows.groupBy("page").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    return pages.select("page", *[F.col(f"rows.{k}").alias(k) for k in fields])


def write_document(pages: DataFrame, path: str) -> None:
    """Pages as JSON documents, one line each, written by the executors."""
    pages.select(F.to_json(F.struct(*pages.columns)).alias("value")).write.mode("overwrite").text(path)
