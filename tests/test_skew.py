"""Hot keys: one customer owns a third of all orders and one product a third
of all order lines.  Broadcast joins are switched off and AQE's skew
thresholds lowered so the skewed sort-merge-join path actually runs; the
results must still equal the DuckDB oracle on the same (skewed) tables.
The fact files are written with small row groups: AQE splits a hot reducer
partition along map-task boundaries, so it needs more than one map task --
as any real multi-row-group input has."""

import re
import tempfile

import duckdb
import pytest

from salesdeck.params import DEFAULT
from salesdeck.registry import ANALYSES
from salesdeck.sources.star import load_star
from tests.conftest import SF_MID
from tests.oracle_check import check

HOT = ["rep_performance", "office_performance", "customer_segments", "segment_summary_all",
       "dormant_with_segment", "product_line_by_year", "monthly_revenue", "agg_count_distinct",
       "join_inner", "org_hierarchy", "fulfilment_outliers", "vip_customers", "kpi_strip",
       "low_stock", "product_performance", "priority_restock"]

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1024",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16384",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "16",
    "spark.sql.files.maxPartitionBytes": "65536",
    "spark.sql.files.openCostInBytes": "0",
}


@pytest.fixture(scope="module")
def skewed_dir():
    out = tempfile.mkdtemp(prefix="salesdeck-skew-")
    con = duckdb.connect()
    for t in ("region", "nation", "supplier", "part", "customer"):
        con.execute(f"COPY (SELECT * FROM read_parquet('{SF_MID}/{t}.parquet')) "
                    f"TO '{out}/{t}.parquet' (FORMAT parquet)")
    con.execute(f"""COPY (SELECT * REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN 7 ELSE o_custkey END
                                           AS o_custkey)
                          FROM read_parquet('{SF_MID}/orders.parquet'))
                    TO '{out}/orders.parquet' (FORMAT parquet, ROW_GROUP_SIZE 2048)""")
    con.execute(f"""COPY (SELECT * REPLACE (CASE WHEN l_orderkey % 3 = 1 THEN 13 ELSE l_partkey END
                                           AS l_partkey)
                          FROM read_parquet('{SF_MID}/lineitem.parquet'))
                    TO '{out}/lineitem.parquet' (FORMAT parquet, ROW_GROUP_SIZE 4096)""")
    return out


@pytest.fixture()
def skew_conf(spark):
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def test_hot_keys_match_oracle(spark, skewed_dir, skew_conf):
    res = check(spark, skewed_dir, HOT, verbose=False)
    bad = {k: v for k, v in res.items() if v[0] != "OK"}
    assert not bad, bad


def test_skew_split_really_happens(spark, skewed_dir, skew_conf):
    df = ANALYSES["monthly_revenue"](load_star(spark, skewed_dir), DEFAULT)  # prices every line first
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in final
    assert re.search(r"SortMergeJoin.*skew=true", final), "AQE did not split the hot partition"


PRODUCT_KEYED = ["low_stock", "product_performance", "priority_restock"]


@pytest.mark.parametrize("name", PRODUCT_KEYED)
def test_hot_product_is_summed_before_the_shuffle(spark, skewed_dir, skew_conf, name):
    """A product with a third of the lines: no task reads more than its share of the per-product sums."""
    df = ANALYSES[name](load_star(spark, skewed_dir), DEFAULT)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    found = []

    def walk(node):
        if node.nodeName() in ("Exchange", "ShuffleExchange") and "productCode" in node.simpleString(200):
            rows = node.metrics().get("shuffleRecordsWritten")
            if rows.isDefined():
                found.append(rows.get().value())
        inner = [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "AdaptiveSparkPlan":
            inner.append(node.executedPlan())
        if "QueryStage" in node.nodeName():
            inner.append(node.plan())
        for c in inner:
            walk(c)

    walk(plan)
    lines = spark.read.parquet(f"{skewed_dir}/lineitem.parquet").count()
    products = spark.read.parquet(f"{skewed_dir}/part.parquet").count()
    tasks = 16
    assert found and max(found) < lines            # the shuffle carries partial sums
    # at most one row of a product per map task: a hot product can't fill a reducer
    assert max(found) <= products * max(tasks, 64)
