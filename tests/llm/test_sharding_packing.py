import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from salesdeck.llm.packing import TOKENIZER, VOCABULARY, Encoder, encoder_of, op2_cost_balanced_packing, pack, pack_block
from salesdeck.llm.sharding import op1_rendezvous_sharding, shard_of, with_slots

from .helpers import EDGES, documents, prose, write

ROWS = EDGES + [(50 + i, prose(i, 20 + 13 * i % 700), "a") for i in range(120)]


def test_shards_of_documents(spark, tmp_path):
    folder = write(documents(spark, ROWS), tmp_path, "documents")
    rows = op1_rendezvous_sharding(spark, folder).collect()
    assert len(rows) == len(ROWS)
    texts = defaultdict(list)
    for i, t, _ in ROWS:
        texts[i].append((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())))
    slots = defaultdict(list)
    for r in rows:
        assert (r.size, r.text_crc32) in texts[r.doc_id] and r.law == "key"
        assert 0 <= r.shard < 40 and r.grown_shard in (r.shard, 40)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shares_follow_weights_and_little_moves(spark):
    keys = spark.range(40_000)
    rows = keys.select(shard_of(F.col("id"), [1, 2, 5]).alias("a"), shard_of(F.col("id"), [1, 2, 5, 2]).alias("b"))
    counts = {tuple(r)[:2]: r["count"] for r in rows.groupBy("a", "b").count().collect()}
    share = [sum(n for (a, _), n in counts.items() if a == s) / 40_000 for s in range(3)]
    assert np.allclose(share, [1 / 8, 2 / 8, 5 / 8], atol=0.01)
    moved = sum(n for (a, b), n in counts.items() if a != b)
    assert all(b in (a, 3) for a, b in counts) and abs(moved / 40_000 - 0.2) < 0.01


def test_slots_of_one_shard_spread_over_buckets(spark):
    rows = with_slots(spark.range(1000).withColumn("shard", F.lit(0)), "id", "shard", buckets=8)
    assert sorted(r.slot for r in rows.collect()) == list(range(1000))


def test_weights_must_be_positive():
    with pytest.raises(ValueError):
        shard_of(None, [1.0, 0.0])


TEXTS = ["", "a", " a", "  a", "a  b", "a   b ", "a \n b", "a\n b", "a \nb", "x  y", "tab\t x  ", "don't we'll 12 345,6 ...",
         "<|endoftext|> text", "é ñ 漢字 🙂 🙂", "\n\n\n", "   ", "a \x0b b", prose(1, 50)]


def test_token_ids_equal_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    encoder = Encoder(VOCABULARY, remembered=20)
    for text in TEXTS + [t for _, t, _ in EDGES if t]:
        want = whole.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == want, text


def test_texts_are_encoded_whole_when_parts_do_not_come_again():
    texts = [prose(seed, 60, 10 ** 9) for seed in range(6)] + TEXTS
    kept = Encoder(VOCABULARY)
    short = Encoder(VOCABULARY, remembered=100)
    assert [short.ids(t) for t in texts] == [kept.ids(t) for t in texts]
    assert short.whole and not kept.whole
    again = Encoder(VOCABULARY, remembered=4)
    for _ in range(50):
        again.ids("one two three four")
    again.ids("five")
    assert not again.whole


def test_a_worker_loads_the_tokenizer_once(spark):
    def loaded(batches):
        for _ in batches:
            made = encoder_of(VOCABULARY, TOKENIZER)
            made.ids("one two")
            yield pa.RecordBatch.from_pydict({"same": [encoder_of(VOCABULARY, TOKENIZER) is made and " two" in made]})

    assert all(r.same for r in spark.range(8, numPartitions=2).mapInArrow(loaded, "same boolean").collect())


def check_pieces(pieces, rows, end=0):
    encoder = Encoder(VOCABULARY)
    ids = defaultdict(list)
    for i, t, _ in rows:
        ids[i].append(encoder.ids(t or "") + np.array([end], "<u4").tobytes())
    per_doc, per_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        per_doc[p.doc_id].append((p.start, p.length, p.ids_crc32, p.doc_tokens))
        per_sequence[p.sequence_id].append((p.offset, p.length))
    assert set(per_doc) == set(ids)
    for i, found in per_doc.items():
        for copies in ids[i]:
            if len(ids[i]) == 1:
                at = 0
                for start, length, crc, tokens in sorted(found):
                    assert start == at and tokens == len(copies) // 4
                    assert crc == zlib.crc32(copies[4 * start:4 * (start + length)])
                    at += length
                assert at == len(copies) // 4
    assert sum(p.length for p in pieces) == sum(len(x) // 4 for v in ids.values() for x in v)
    for found in per_sequence.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 1024
    return len(per_sequence)


def test_packing(spark, tmp_path):
    folder = write(documents(spark, ROWS).repartition(1), tmp_path, "documents")
    pieces = op2_cost_balanced_packing(spark, folder).collect()
    sequences = check_pieces(pieces, ROWS)
    assert sequences - sum(p.length for p in pieces) / 1024 < 9  # at most one sequence's padding per task


def test_small_blocks_lose_nothing(spark):
    pieces = pack(documents(spark, ROWS), block=16).collect()
    check_pieces(pieces, ROWS)


def test_empty_table(spark):
    assert pack(documents(spark, [])).count() == 0


def test_block_is_full_and_balanced():
    lengths = np.random.default_rng(3).integers(1, 1024, 500)
    placed = pack_block(lengths, 1024, 1.0, 1 / 4096)
    used, cost, seen = defaultdict(int), defaultdict(float), defaultdict(int)
    for piece, start, take, best in placed:
        assert start == seen[piece]
        seen[piece] += take
        used[best] += take
        cost[best] += take + take * take / 4096
    assert all(seen[i] == n for i, n in enumerate(lengths)) and max(used.values()) <= 1024
    assert len(used) == -(-int(lengths.sum()) // 1024)
    assert max(cost.values()) < 1.35 * np.mean(list(cost.values()))


def test_added_tokens_inside_texts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [*TEXTS, "a <|endoftext|> text", "<|endoftext|><|endoftext|>", " <|endoftext|>  a", "<|endoftext", "x<|endoftext|>"]
    pieces = pack(documents(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()
    got = {p.doc_id: np.frombuffer(p.ids, "<u4").tolist() for p in pieces if p.length == p.doc_tokens}
    for i, text in enumerate(texts):
        if i in got:
            assert got[i] == [*whole.encode(text, add_special_tokens=False).ids, 0], text
    assert len(got) > len(texts) - 3  # a block's sequences may cut a piece


def test_pieces_without_ids_are_the_same(spark):
    docs = documents(spark, ROWS).repartition(3, "doc_id")
    facts = ["doc_id", "start", "length", "doc_tokens", "ids_crc32", "sequence_id", "offset"]
    with_ids, bare = pack(docs).select(*facts), pack(docs, with_ids=False)
    assert bare.columns == facts
    assert sorted(map(tuple, with_ids.collect()), key=repr) == sorted(map(tuple, bare.collect()), key=repr)


def test_ordered_rows_are_packed_without_a_shuffle(spark, tmp_path):
    """Rows as stored, in several files and blocks; the order of their sequences is that of the files and rows."""
    rows = [(i, t, s) for i, (_, t, s) in enumerate(ROWS)]
    documents(spark, rows).coalesce(1).sortWithinPartitions("doc_id").write.option("maxRecordsPerFile", 30).parquet(f"{tmp_path}/t")
    docs = spark.read.parquet(f"{tmp_path}/t")
    made = pack(docs, stored=True, block=16)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "rangepartitioning" not in plan and "Exchange hashpartitioning(key" not in plan
    pieces = made.collect()
    check_pieces(pieces, rows)
    place = [p.doc_id for p in sorted(pieces, key=lambda p: p.sequence_id)]
    assert all(x > y - 32 for x, y in zip(place, place[1:], strict=False)) and place[0] < 16
    for other in (pack(docs.union(docs.limit(0)), stored=True), pack(docs, order=[-F.col("doc_id")], block=16)):
        check_pieces(other.collect(), rows)
    assert pack(docs.filter("doc_id < 0"), stored=True).count() == 0
