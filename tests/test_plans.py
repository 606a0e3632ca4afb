"""Plan shape: what Catalyst produced, not just what it returned."""

import re

import pytest

from salesdeck.params import DEFAULT
from salesdeck.registry import ANALYSES
from salesdeck.sources.star import load_star
from tests.conftest import SF_SMALL

# rank or write a layout while building; checked separately
EAGER = {"rep_rank", "rep_json_document", "scan_filtered", "table_page_stored", "rep_performance_bucketed", "monthly_refreshed",
         "repaired_orders", "rejected_orders", "country_profit", "table_statistics"}


@pytest.fixture(scope="module")
def star(spark):
    return load_star(spark, SF_SMALL)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(ANALYSES) - EAGER))
def test_no_python_udf_and_no_cartesian(star, name):
    p = plan(ANALYSES[name](star, DEFAULT))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "CartesianProduct",
                "BroadcastNestedLoopJoin"):
        assert bad not in p, f"{name}: {bad}"


def test_distinct_counts_need_no_expand(star):
    for name in ("rep_performance", "office_performance", "monthly_revenue", "customer_segments_all"):
        assert "Expand" not in plan(ANALYSES[name](star, DEFAULT)), name


def test_projection_and_filter_reach_the_scan(star):
    p = plan(ANALYSES["scan_projected"](star, DEFAULT))
    assert "ReadSchema: struct<p_partkey:bigint,p_type:string>" in p
    p = plan(ANALYSES["filter_not_cancelled"](star, DEFAULT))
    assert "PushedFilters: [IsNotNull(o_orderstatus), Not(EqualTo(o_orderstatus,P))]" in p


def test_top_k_is_take_ordered(star):
    for name in ("top_k", "dormant_top15", "vip_customers"):
        assert "TakeOrderedAndProject" in plan(ANALYSES[name](star, DEFAULT)), name


def _broadcast_scans(p: str) -> set[str]:
    """Tables scanned inside BroadcastExchange subtrees of a plan tree string."""
    import re
    lines, found = p.splitlines(), set()
    for i, line in enumerate(lines):
        if "BroadcastExchange" not in line:
            continue
        depth = len(line) - len(line.lstrip(" :+-"))
        # an aggregate keyed only by the tier (a 4-valued CASE) has <= 4 rows
        if i + 1 < len(lines) and re.search(r"HashAggregate\(keys=\[segment#\d+\]", lines[i + 1]):
            continue
        for sub in lines[i + 1:]:
            if len(sub) - len(sub.lstrip(" :+-")) <= depth:
                break
            m = re.search(r"FileScan parquet .*?Location: [^\[]*\[file:[^\]]*/(\w+)\.parquet", sub)
            if m:
                found.add(m.group(1))
    return found


def test_only_bounded_sides_are_broadcast_at_cluster_shape(spark, star):
    """With size-based broadcasting off (the 100 TB shape) the only broadcast
    inputs are nation/region and literal tables."""
    from tools.plan_census import CLUSTER_SHAPE
    old = {k: spark.conf.get(k) for k in CLUSTER_SHAPE}
    try:
        for k, v in CLUSTER_SHAPE.items():
            spark.conf.set(k, v)
        for name in sorted(set(ANALYSES) - EAGER):
            scans = _broadcast_scans(plan(ANALYSES[name](star, DEFAULT)))
            assert scans <= {"nation", "region"}, (name, scans)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def executed(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_rep_rank_is_distributed(star):
    """The only window runs over one row per partition, below a broadcast of the offsets."""
    import re
    df = ANALYSES["rep_rank"](star, DEFAULT)
    p = executed(df).split("== Initial Plan ==")[0]
    windows = re.findall(r"Window \[.*?\]", p)
    assert windows and all("__n" in w for w in windows) and "row_number" not in p
    ranks = sorted(r["rank"] for r in df.collect())
    assert ranks == list(range(1, len(ranks) + 1))


def test_building_an_analysis_runs_no_job(spark, star):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "")
    try:
        for name in sorted(set(ANALYSES) - EAGER):
            ANALYSES[name](star, DEFAULT)
        assert list(tracker.getJobIdsForGroup("building")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def at_cluster_shape(spark, build):
    from tools.plan_census import CLUSTER_SHAPE
    old = {k: spark.conf.get(k) for k in CLUSTER_SHAPE}
    try:
        for k, v in CLUSTER_SHAPE.items():
            spark.conf.set(k, v)
        return build()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_lines_are_summed_before_products_are_joined(spark, star):
    """Nothing but a partial sum by product stands between the line scan and its first shuffle."""
    for name in ("low_stock", "product_performance", "priority_restock", "agg_avg"):
        p = at_cluster_shape(spark, lambda: plan(ANALYSES[name](star, DEFAULT)))
        above = [x for x in p.splitlines() if "lineitem.parquet" in x or "Exchange" in x or "partial_sum" in x]
        for i, line in enumerate(above):
            if "lineitem.parquet" in line:
                assert "partial_sum" in above[i - 1] and "Exchange hashpartitioning(productCode" in above[i - 2], name


def test_one_line_scan_per_analysis(spark, star):
    for name in ("priority_restock", "fulfilment_outliers"):
        p = at_cluster_shape(spark, lambda: executed(ANALYSES[name](star, DEFAULT))).split("== Initial Plan ==")[0]
        main = p.split("Subqueries")[0]
        assert main.count("lineitem.parquet") - main.count("ReusedExchange") <= 1, name


def test_shipped_filter_is_pushed_into_the_stored_layout(star):
    p = plan(ANALYSES["scan_filtered"](star, DEFAULT))
    assert "PartitionFilters: [isnotnull(shippedYear" in p and "PushedFilters: [IsNotNull(shippedDate)]" in p
    assert "Exchange" not in p and p.count("FileScan") == 1 and "lineitem" not in p


def test_outliers_never_deal_orders_by_status(spark, star):
    """At cluster shape an exchange on status carries partial means only, and no join has that key."""
    p = at_cluster_shape(spark, lambda: plan(ANALYSES["fulfilment_outliers"](star, DEFAULT)))
    lines = p.splitlines()
    dealt = [i for i, x in enumerate(lines) if "Exchange hashpartitioning(status" in x]
    assert dealt and all("partial_avg" in lines[i + 1] for i in dealt)
    assert "Join [status" not in p
    assert len(set(re.findall(r"Subquery (subquery#\d+)", p))) == 1


def test_key_figures_take_one_pass(spark, star):
    p = at_cluster_shape(spark, lambda: plan(ANALYSES["kpi_strip"](star, DEFAULT)))
    assert p.count("lineitem.parquet") == 1 and p.count("/orders.parquet") == 1
    assert len([x for x in p.splitlines() if "Exchange hashpartitioning" in x or "Exchange SinglePartition" in x]) <= 12


def test_unordered_marts_skip_the_global_sort(star):
    from dataclasses import replace
    for name in ("customer_segments", "dormant_with_segment", "product_performance", "org_hierarchy"):
        assert "rangepartitioning" in plan(ANALYSES[name](star, DEFAULT)), name
        assert "rangepartitioning" not in plan(ANALYSES[name](star, replace(DEFAULT, ordered=False))), name
