"""Row sink round trip and the column document."""

import json
import tempfile

from salesdeck.plans import customers, documents
from salesdeck.sinks import write_document, write_rows
from salesdeck.session import cluster_conf
from tests.fixtures import PARAMS, micro_star


def test_json_rows_round_trip(spark):
    star = micro_star(spark)
    df = customers.dormant_with_segment(star, PARAMS)
    out = tempfile.mkdtemp(prefix="salesdeck-sink-")
    write_rows(df, out + "/dormant", fmt="json")
    back = spark.read.schema(df.schema).json(out + "/dormant")
    assert sorted(back.collect()) == sorted(df.collect())
    write_rows(df, out + "/dormant_pq", fmt="parquet", partition_by=["country"])
    assert spark.read.parquet(out + "/dormant_pq").count() == df.count()


def test_rep_document_holds_all_reps_in_pages(spark, tmp_path):
    from dataclasses import replace
    pages = documents.rep_json_document(micro_star(spark), replace(PARAMS, document_page=3))
    write_document(pages, f"{tmp_path}/doc")
    docs = sorted((json.loads(r.value) for r in spark.read.text(f"{tmp_path}/doc").collect()), key=lambda d: d["page"])
    assert [d["page"] for d in docs] == [0, 1]
    assert [x for d in docs for x in d["x"]] == [199999.99, 90099.98, 51000.0, 49999.99]
    assert docs[0]["y"][0] == "Ines Okafor" and docs[0]["orders"] == [2, 4, 2] and docs[1]["customers"] == [1]
    assert set(docs[0]) == {"page", "x", "y", "office", "customers", "orders"}


def test_cluster_conf_scales_with_input():
    small = cluster_conf(10 << 30, 64)
    big = cluster_conf(100 << 40, 8000)
    assert int(small["spark.sql.shuffle.partitions"]) == 128
    reducers, split = int(big["spark.sql.shuffle.partitions"]), int(big["spark.sql.files.maxPartitionBytes"])
    assert reducers == 81920                       # 20 TB of shuffle in 256 MB parts
    assert (100 << 40) / split * reducers <= 2.5e9  # blocks of one exchange
