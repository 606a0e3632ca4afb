import corpus_pipeline
from pyspark.sql import functions as F

from .helpers import EDGES, documents, prose, write
from .test_dedup import exact_by_hand, near_by_hand
from .test_quality_mixing import WORD, boilerplate_rows, verdicts_by_hand
from .test_sharding_packing import check_pieces


def rows():
    clean = [(2000 + i, prose(9000 + i, 80 + i), "abc"[i % 3]) for i in range(30)]
    copies = [(3000 + i, prose(9100, 90).replace(" ", "  " if i % 2 else " "), "a") for i in range(12)]
    near = [(4000 + i, prose(9200, 400) + f" v{i}", "c") for i in range(6)]
    return EDGES + clean + copies + near + boilerplate_rows()


def without(text, host, removed):
    lines = text.split("\n")
    kept = [x for x in lines if (host, " ".join(WORD.findall(x)).lower()) not in removed]
    return text if len(kept) == len(lines) else "\n".join(kept)


def test_stages_against_brute_force(spark, tmp_path):
    table = rows()
    docs = documents(spark, table)
    write(docs, tmp_path, "documents")
    (_, quality), (_, exact), (_, near), (_, mixing), (_, packing) = corpus_pipeline.STAGES

    kept = quality(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    removed, passed = verdicts_by_hand(table)
    assert len(removed) == 3 and sum(passed) < len(table) - 30
    want = [(i, without(t, s, removed), s) for (i, t, s), ok in zip(table, passed, strict=True) if ok]
    got = [(r.doc_id, r.text, r.source) for r in kept.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert all(r.n_chars == len(r.text) for r in kept.collect())
    assert verdicts_by_hand(got)[0] == set()  # no line over the limits goes on

    kept = exact(spark, documents(spark, got), str(tmp_path))
    want = {i for i, _, _, keep, _ in exact_by_hand(got) if keep}
    got = [(r.doc_id, r.text, r.source) for r in kept.collect()]
    assert {i for i, _, _ in got} == want and len(got) == len(want)

    kept = near(spark, documents(spark, got), str(tmp_path))
    want = {c for _, _, c in near_by_hand(got)}
    got = [(r.doc_id, r.text, r.source) for r in kept.collect()]
    assert {i for i, _, _ in got} == want and len(got) == len(want)

    mixed = mixing(spark, documents(spark, got), str(tmp_path))
    assert mixed.columns == docs.columns
    got = [(r.doc_id, r.text, r.source) for r in mixed.collect()]
    assert {i for i, _, _ in got} <= want
    check_pieces(packing(spark, documents(spark, got), str(tmp_path)).collect(), got)


def test_run_equals_its_stages(spark, tmp_path):
    folder = write(documents(spark, rows(), clash=False), tmp_path, "documents")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    facts = lambda df: sorted((r.doc_id, r.doc_tokens) for r in df.collect() if r.start == 0)
    assert facts(corpus_pipeline.run(spark, folder)) == facts(docs)


def test_sequences_follow_the_training_order(spark, tmp_path):
    """Sequence ids follow the order of the written rows up to a block."""
    rows = [(i, prose(i, 30), "s") for i in range(9000)]
    table = documents(spark, rows, clash=False).repartition(40)
    table.orderBy(F.desc("doc_id")).write.parquet(f"{tmp_path}/mixed")
    docs = spark.read.parquet(f"{tmp_path}/mixed")
    pieces = corpus_pipeline.packing(spark, docs, str(tmp_path)).collect()
    check_pieces(pieces, rows)
    place = [8999 - p.doc_id for p in sorted(pieces, key=lambda p: p.sequence_id)]
    highest = 0
    for x in place:
        highest = max(highest, x)
        assert x > highest - 4200
    assert max(place[:500]) < 4200 and min(place[-500:]) > 4200
