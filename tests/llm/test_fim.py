import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from salesdeck.llm.fim import SkipList, coins, fill_in_middle, op13_indexable_skip_list, restored, token_ends, transform

from .helpers import EDGES, documents, prose, write

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ROWS = EDGES + [(50 + i, prose(i, 5 + 7 * i % 90), "a") for i in range(60)] + \
    [(200, "a <P> b", "a"), (201, "<S>", "a"), (202, "x<M>", "a"), (203, "< S > <p> <", "a")] + \
    [(300 + i, "é🙂 漢字 x\x85y\x1c z \t" * (i + 1), "a") for i in range(20)]


def brute(key, text):
    """The contract, token by token."""
    tokens = TOKEN.findall(text)
    n = len(tokens)
    digest = hashlib.sha256(f"42:{key}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10_000), st.text(alphabet="ab é🙂\t\n\x0b\x1c <>PSM", max_size=40))
def test_transform_equals_brute_force(key, text):
    assert transform(text, str(key)) == brute(key, text)
    assert np.diff(token_ends(text), prepend=0).tolist() == [len(t) for t in TOKEN.findall(text)]


def test_every_rank_is_reached_in_few_links():
    widths = np.random.default_rng(1).integers(1, 30, 20_000)
    tokens = SkipList(widths)
    before = np.concatenate(([0], np.cumsum(widths)))
    most = 0
    for rank in [*range(300), *range(300, 20_001, 17), 20_000]:
        chars, links = tokens.seek(rank)
        assert chars == before[rank]
        most = max(most, links)
    assert len(tokens.lanes) >= 6 and most < 100
    with pytest.raises(IndexError):
        tokens.seek(20_001)


def test_lanes_carry_the_widths_of_what_they_pass():
    widths = np.arange(1, 501)
    tokens = SkipList(widths)
    assert np.array_equal(np.bincount(coins(500))[:1], [len(tokens.lanes[0][1]) - len(tokens.lanes[1][1])])
    for down, units, chars in tokens.lanes[1:]:
        ends = np.cumsum(units)
        assert np.array_equal(np.cumsum(chars), ends * (ends + 1) // 2) and len(down) == len(units)


def test_query_equals_brute_force(spark, tmp_path):
    rows = op13_indexable_skip_list(spark, write(documents(spark, ROWS), tmp_path, "documents")).collect()
    want = []
    for i, t, _ in ROWS:
        n, form, p, m, out = brute("" if i is None else i, t or "")
        want.append((i, n, form, p, m, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


def test_texts_come_back_and_columns_stay(spark):
    docs = documents(spark, ROWS)
    made = fill_in_middle(docs, rate=100)
    assert made.columns == [*docs.columns, "fim"]
    assert made.filter(restored(F.col("fim.output"), F.col("fim.form")) != F.coalesce("text", F.lit(""))).count() == 0
    assert made.filter((F.col("fim.form") != "plain") & (F.col("fim.output") == F.col("text"))).count() == 0


def test_empty_table(spark, tmp_path):
    assert op13_indexable_skip_list(spark, write(documents(spark, []), tmp_path, "documents")).collect() == []
