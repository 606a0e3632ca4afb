"""Count plan nodes per analysis: shuffles, broadcasts, reused exchanges,
sort-merge joins, and scans of the line table.  Static (pre-AQE) plans.

    python tools/plan_census.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from salesdeck.params import DEFAULT  # noqa: E402
from salesdeck.plans.people import rep_rows  # noqa: E402
from salesdeck.registry import ANALYSES  # noqa: E402
from salesdeck.session import get_session  # noqa: E402
from salesdeck.sources.star import load_star  # noqa: E402


def census(df) -> dict[str, int]:
    p = df._jdf.queryExecution().executedPlan().toString()
    return {
        "shuffle": len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", p)),
        "broadcast": p.count("BroadcastExchange"),
        "reused": p.count("ReusedExchange") + p.count("ReusedSubquery"),
        "smj": p.count("SortMergeJoin"),
        "lineitem_scans": len(re.findall(r"FileScan parquet \[l_", p)),
        "subqueries": p.count("Subquery subquery"),
    }


# Analyses that rank while they are built: what they return starts from the
# checkpointed ranking, so the plan below it is counted as well.
RANKED = {"rep_rank": rep_rows, "rep_json_document": rep_rows}


def census_of(name: str, star) -> dict[str, int]:
    counts = census(ANALYSES[name](star, DEFAULT))
    if name in RANKED:
        below = census(RANKED[name](star, DEFAULT))
        counts = {k: v + below[k] for k, v in counts.items()}
        counts["shuffle"] += 1  # the range shuffle of the ranking
    return counts


# size-based broadcasts off: the plan shape when no data-dependent side fits
# in memory (the 100 TB case); explicit hints on bounded sides still apply
CLUSTER_SHAPE = {"spark.sql.autoBroadcastJoinThreshold": "-1",
                 "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}


def markdown(spark, star, names) -> str:
    rows = ["| analysis | shuffles | broadcasts | SMJ | line scans | shuffles (cluster shape) | "
            "broadcasts (cluster shape) | SMJ (cluster shape) |", "|---|---|---|---|---|---|---|---|"]
    base = {n: census_of(n, star) for n in names}
    for k, v in CLUSTER_SHAPE.items():
        spark.conf.set(k, v)
    big = {n: census_of(n, star) for n in names}
    for n in names:
        a, b = base[n], big[n]
        rows.append(f"| `{n}` | {a['shuffle']} | {a['broadcast']} | {a['smj']} | {a['lineitem_scans']} | "
                    f"{b['shuffle']} | {b['broadcast']} | {b['smj']} |")
    return "\n".join(rows)


if __name__ == "__main__":
    args = [a for a in sys.argv[1:] if a != "--md"]
    sf = args[0] if args else "/root/testdata/sf0.1"
    spark = get_session()
    star = load_star(spark, sf)
    names = args[1:] or list(ANALYSES)
    if "--md" in sys.argv:
        print(markdown(spark, star, names))
        sys.exit(0)
    print(f"{'analysis':28s} shuffle bcast reused smj line_scans subq")
    for n in names:
        c = census_of(n, star)
        print(f"{n:28s} {c['shuffle']:7d} {c['broadcast']:5d} {c['reused']:6d} {c['smj']:3d} "
              f"{c['lineitem_scans']:10d} {c['subqueries']:4d}")
