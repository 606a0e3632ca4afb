"""Refresh job: compute many analyses in one run and write them as marts.

Run independently, every analysis re-reads the line table and re-derives
the same order-, customer- and rep-level aggregates.  ``refresh_marts``
computes those shared facts once, writes them to the folder the cluster
names in ``spark.checkpoint.dir`` (``DataFrame.checkpoint``: reliable,
lineage cut, survives executor loss), and runs every requested analysis on
top of them; each result is written by the executors as Parquet.  The
interactive filter of the reference then becomes ``api.filter_segment`` on
the written mart.

    python -m salesdeck.jobs <tables_dir> <out_dir> [name ...]
"""

from __future__ import annotations

import sys
from dataclasses import replace

from pyspark.sql import SparkSession

from salesdeck.params import DEFAULT, Params
from salesdeck.plans import distinct, facts
from salesdeck.registry import ANALYSES
from salesdeck.session import ensure_checkpoint_dir
from salesdeck.sinks import write_document, write_rows
from salesdeck.sources.star import Star, load_star

# marts with a natural partition column: written partitioned by it
PARTITIONS = {"monthly_revenue": ["year"], "monthly_revenue_period": ["year"],
              "product_line_by_year": ["year"]}


def materialise_facts(star: Star, params: Params = DEFAULT) -> Star:
    """A star whose shared aggregates are checkpointed once."""
    ensure_checkpoint_dir(star.orders.sparkSession)
    # ship date per order: an aggregate of the line table used by six analyses
    s = replace(star, memo=dict(star.memo), shipments=None if star.shipments is None else star.shipments.checkpoint())
    s.memo["order_totals"] = facts._order_totals(s).checkpoint()
    for inc in (True, False):
        key = f"customer_totals/{inc}/{params.cancelled}/{params.keep_null_status}"
        s.memo[key] = facts._customer_totals(s, params, inc).checkpoint()
    s.memo["rep_totals"] = facts._rep_totals(s, params).checkpoint()
    s.memo["customer_bitmaps"] = distinct._customer_bitmaps(s, params).checkpoint()
    return s


def refresh_marts(star: Star, out_dir: str, names: list[str] | None = None,
                  params: Params = DEFAULT) -> dict[str, str]:
    shared = materialise_facts(star, params)
    # a written mart needs no global ORDER BY (top-k lists keep theirs)
    params = replace(params, ordered=False)
    written = {}
    for name in names or list(ANALYSES):
        path = f"{out_dir}/{name}"
        if name == "rep_json_document":
            write_document(ANALYSES[name](shared, params), path)
        else:
            write_rows(ANALYSES[name](shared, params), path, fmt="parquet",
                       partition_by=PARTITIONS.get(name))
        written[name] = path
    return written


def main(argv: list[str]) -> None:
    spark = SparkSession.builder.getOrCreate()
    tables, out, *names = argv
    refresh_marts(load_star(spark, tables), out, names or None)


if __name__ == "__main__":
    main(sys.argv[1:])
