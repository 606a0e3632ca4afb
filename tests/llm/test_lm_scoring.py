import zlib
from collections import Counter

import numpy as np
import pytest

from salesdeck.llm.lm_scoring import grams_of, op9_probabilistic_suffix_tree, packed_by_chunk, score_documents, training, words_and_bytes

from .helpers import EDGES, documents, prose, write
from .suffix_automaton import run_automaton, suffix_tree


def tree_of(texts, depth):
    data = [words_and_bytes(t)[1] for t in texts]
    counts = Counter()
    for t in data:
        padded = b"\n" * depth + t
        for i in range(depth, len(padded)):
            for d in range(depth + 1):
                counts[d, int.from_bytes(padded[i - d:i + 1], "big")] += 1
    d, pair = (np.array(x, np.int64) for x in zip(*counts, strict=True))
    return suffix_tree(d, pair, np.array(list(counts.values()), float), depth)


def test_grams_of_a_buffer():
    keep = np.ones(9, bool)
    keep[:2] = False
    keys, n = grams_of(b"\n\nabababa", 2, keep)
    got = {int(k).to_bytes(3, "big"): c for k, c in zip(keys, n, strict=True)}
    assert got == {b"\n\na": 1, b"\nab": 1, b"aba": 3, b"bab": 2}


def test_distributions_sum_to_one_and_states_are_longest_suffixes():
    texts = [prose(i, 60, 8) for i in range(30)]
    tree = tree_of(texts, 3)
    width = int(tree.classes.max()) + 1
    probs = 10.0 ** tree.log10.astype(float).reshape(-1, width)
    unseen = 256 - (width - 1)
    assert np.allclose(probs[:, :-1].sum(axis=1) + unseen * probs[:, -1], 1, atol=1e-4)
    assert len(probs) > 10


def test_segments_do_not_change_scores():
    texts = [prose(i, 200, 8) for i in range(20)]
    tree = tree_of(texts, 3)
    data = [words_and_bytes(t)[1] for t in [*texts, "", "a", None, "é ü"]]
    assert np.allclose(run_automaton(tree, data, 3, segment=7), run_automaton(tree, data, 3, segment=100_000))


def by_hand(rows):
    counts = Counter()
    for i, t, _ in rows:
        if training(i):
            counts.update(words_and_bytes(t)[0])
            counts[b""] += 1
    total, kinds = sum(counts.values()), len(counts)
    out = []
    for i, t, _ in rows:
        tokens = [*words_and_bytes(t)[0], b""]
        out.append((i, not training(i), len(tokens), sum(counts[w] > 0 for w in tokens), total,
                    sum(np.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in tokens)))
    return out


@pytest.mark.parametrize("frequent", [1 << 20, 30])
def test_base_against_brute_force(spark, frequent):
    rows = EDGES + [(100 + i, prose(i, 120, 900), "a") for i in range(40)]
    got = score_documents(documents(spark, rows), frequent=frequent).collect()
    key = lambda r: (repr(r[0]), r[2])
    assert len(got) == len(rows)
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(by_hand(rows), key=key), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5])
        assert np.isfinite(g[6]) and g[6] < 0


def test_contexts_beat_single_words_on_held_out_texts(spark, tmp_path):
    rng = np.random.default_rng(1)
    after = rng.integers(0, 40, (40, 2))

    def chain(n):
        at, out = 0, []
        for _ in range(n):
            at = int(after[at, rng.integers(0, 2)])
            out.append(f"{chr(97 + at % 26)}{chr(97 + at // 26)}")
        return " ".join(out)

    folder = write(documents(spark, [(i, chain(200), "a") for i in range(300)]), tmp_path, "documents")
    held = [r for r in op9_probabilistic_suffix_tree(spark, folder).collect() if r.held_out]
    assert 40 < len(held) < 80
    base, tree = (sum(r[c] for r in held) / sum(r.n_tokens for r in held) for c in ("base_score", "score"))
    assert tree > base + 0.3  # a word is known to one bit from the one before it


def test_nothing_to_train_on(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    got = score_documents(documents(spark, [(held, "a b", "a")])).collect()
    assert [tuple(r)[:6] for r in got] == [(held, True, 3, 0, 0, None)] and got[0].score < 0
    assert score_documents(documents(spark, [])).count() == 0


def test_rare_contexts_of_a_large_corpus_are_retained(spark):
    """Scores equal those of the tree of all counts, also of contexts that are
    a millionth of the training bytes."""
    filler, rare, depth = prose(5, 4000, 60), "zq\u00fcx zqj", 5
    ids = [i for i in range(400) if training(i)]
    held = [i for i in range(1000) if not training(i)]
    rows = [(i, filler, "a") for i in ids[:150]] + [(i, rare, "a") for i in ids[150:153]]
    rows += [(held[0], rare, "a"), (held[1], "zq new w1 \u6f22", "a"), (held[2], "", "a")]
    counts = Counter()
    for _, t, _ in rows[149:153]:
        data = b"\n" * depth + words_and_bytes(t)[1]
        for i in range(depth, len(data)):
            for d in range(depth + 1):
                counts[d, int.from_bytes(data[i - d:i + 1], "big")] += 150 if t is filler else 1
    d, pair = (np.array(x, np.int64) for x in zip(*counts, strict=True))
    tree = suffix_tree(d, pair, np.array(list(counts.values()), float), depth)
    want = run_automaton(tree, [words_and_bytes(t)[1] for _, t, _ in rows], depth)
    for chunk_bytes in (1 << 25, 100_000):
        got = {r.doc_id: r.score for r in score_documents(documents(spark, rows), chunk_bytes=chunk_bytes).collect()}
        assert [got[i] for i, _, _ in rows] == pytest.approx(want.tolist(), rel=1e-4)


def test_lookups_travel_as_bytes(spark, monkeypatch):
    rows = [(c, g << 20 | c, (-g - c) / 8) for c in range(3) for g in range(200)]
    found = {}
    for r in packed_by_chunk(spark.createDataFrame(rows, "chunk long, gram long, log10 float").repartition(2), "gram", "log10").collect():
        grams, logs = np.frombuffer(r.grams, np.int64), np.frombuffer(r.grams_log10, np.float32)
        found.setdefault(r.chunk, []).extend(zip(grams.tolist(), logs.tolist(), strict=True))
    assert {c: sorted(x) for c, x in found.items()} == {c: [(g, v) for k, g, v in rows if k == c] for c in range(3)}
    words = [(c, w, n) for c in range(2) for n, w in enumerate((b"", b"one", "é".encode(), b"\xc2\xa0"))]
    found = set()
    for r in packed_by_chunk(spark.createDataFrame(words, "chunk long, word binary, times long"), "word", "times").collect():
        found |= {(r.chunk, w, n) for w, n in zip(bytes(r.words).split(b"\n"), np.frombuffer(r.words_times, np.int64).tolist(), strict=True)}
    assert found == set(words)


def test_scores_with_all_words_rare_equal_those_with_all_frequent(spark):
    rows = [(n, f"w{n % 7} w{n} common \xa0 x") for n in range(60)] + [(100, None), (101, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, two = ({r.doc_id: (r.n_tokens, r.n_known, round(r.base_score, 9), r.score) for r in score_documents(docs, frequent=f, chunk_bytes=200).collect()}
                for f in (1, 1 << 20))
    assert one == two and len(one) == len(rows)
