import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from salesdeck.llm import toxicity
from salesdeck.llm.toxicity import (BUCKETS, FILTERS, WIDTHS, Network, Scorer, Unit, best_cut, cuts, first_network, fit, fit_labelled, ids_of, labelled_sample,
                                    labelled_units, op12_convolutional_classifier, passes_of, pieces_of, scores, strongest, train, unit_logits, words_of)

from .helpers import EDGES, documents, write

RNG = random.Random(11)
INSULTS = {"en": ["grobble", "snark"], "de": ["blödung", "fiesling"]}


def text_of(lang, toxic, words):
    made = [f"{'w' if lang == 'en' else 'ü'}{RNG.randrange(600)}" for _ in range(words)]
    for _ in range(RNG.randrange(1, 4) if toxic else 0):
        made.insert(RNG.randrange(len(made) + 1), RNG.choice(INSULTS[lang]) + RNG.choice(("", "s", "en", ".")))
    return " ".join(made)


LABELLED = []
for n in range(700):
    lang, toxic = RNG.choice(("en", "de")), int(RNG.random() < 0.3)
    LABELLED.append((1000 + n, text_of(lang, toxic, RNG.randrange(1, 150)), lang, toxic))


def labels_of(spark, rows, extra=()):
    return spark.createDataFrame([(i, 1, y) for i, _, _, y in rows] + list(extra), "doc_id long, quality int, toxic int")


def tables(spark, folder, rows, extra=(), labels=()):
    docs = documents(spark, [(i, t, "a") for i, t, _, _ in rows] + list(extra))
    langs = {i: lang for i, _, lang, _ in rows}
    keep = [(i, langs.get(i)) for i in {*langs, *[r[0] for r in extra]}]
    named = spark.createDataFrame(keep, "k long, l string")
    docs = docs.drop("lang").join(named, docs.doc_id.eqNullSafe(named.k)).drop("k").withColumnRenamed("l", "lang")
    write(docs, folder, "documents")
    write(labels_of(spark, rows, labels), folder, "labels")
    return str(folder)


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


@pytest.fixture(scope="module")
def result(spark, tmp_path_factory):
    folder = tables(spark, tmp_path_factory.mktemp("toxicity"), LABELLED, EDGES, [(None, 1, 1), (1, 1, None), (1001, None, None)])
    return op12_convolutional_classifier(spark, folder).collect()


def test_held_out_rows_are_told_apart(result):
    truth = {i: y for i, _, _, y in LABELLED}
    unseen = [r for r in result if r.doc_id in truth and held_out(r.doc_id)]
    assert len(unseen) > 100 and all(r.held_out for r in unseen)
    assert np.mean([r.predicted == truth[r.doc_id] for r in unseen]) >= 0.97
    assert np.mean([r.flagged == truth[r.doc_id] for r in unseen]) >= 0.97


def test_every_row_has_a_score(result):
    assert len(result) == len(LABELLED) + len(EDGES)
    for r in result:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.flagged == int(r.score >= r.threshold)
        assert r.held_out == (r.doc_id is None or held_out(r.doc_id))
    assert len({r.threshold for r in result}) >= 2
    # EDGES repeats a row and holds texts without words
    assert len({r.score for r in result if r.doc_id == 5}) == 1 and len({r.score for r in result if r.doc_id in (1, 2, 3)}) == 1


def test_held_out_labels_languages_and_ids_change_no_score(spark, tmp_path, result):
    flipped = [(i, t, lang, 1 - y if held_out(i) else y) for i, t, lang, y in LABELLED]
    folder = tables(spark, tmp_path, flipped, EDGES)
    assert {(r.doc_id, r.score) for r in op12_convolutional_classifier(spark, folder).collect()} == {(r.doc_id, r.score) for r in result}
    texts = [t for _, t, _, _ in LABELLED[:200]]
    net = fit(texts, [y for *_, y in LABELLED[:200]], ["en"] * 200)
    one = spark.createDataFrame([(1, "en", t) for t in texts], "doc_id long, lang string, text string")
    two = spark.createDataFrame([(2, None, t) for t in texts], "doc_id long, lang string, text string")
    a, b = ([r.toxicity.score for r in scores(x, net).orderBy("text").collect()] for x in (one, two))
    assert a == b and len(set(a)) > 50


def brute_logit(net: Network, text: str) -> float:
    vectors = [net.embedded[pieces_of(w)].sum(axis=0) for w in words_of(text.lower())]
    n = max(1, len(vectors))
    vectors += [np.zeros(net.embedded.shape[1])] * (n + max(WIDTHS) - len(vectors))
    pooled = [max(sum(float(vectors[t + j] @ w[j, :, f]) for j in range(len(w))) for t in range(n)) for w in net.filters for f in range(FILTERS)]
    return float(np.maximum(np.array(pooled) + net.bias, 0) @ net.out[:-1] + net.out[-1])


def test_scorer_equals_brute_force(monkeypatch):
    rng = np.random.default_rng(3)
    net = Network(np.append(rng.normal(0, 1, (BUCKETS, toxicity.EMBEDDED)), np.zeros((1, toxicity.EMBEDDED)), axis=0).astype(np.float32),
                  [rng.normal(0, 1, (w, toxicity.EMBEDDED, FILTERS)).astype(np.float32) for w in WIDTHS],
                  rng.normal(0, 1, len(WIDTHS) * FILTERS).astype(np.float32), rng.normal(0, 1, len(WIDTHS) * FILTERS + 1).astype(np.float32))
    texts = ["", " ", "a", "a b", "One two, three!", *[t for _, t, _, _ in LABELLED[:20]], " ".join(f"long{i % 97}" for i in range(500))]
    want = [brute_logit(net, t) for t in texts]
    monkeypatch.setattr(toxicity, "AT_ONCE", 7)       # many parts, and words forgotten between them
    monkeypatch.setattr(toxicity, "REMEMBERED", 20)
    scorer = Scorer(net)
    assert np.allclose([scorer.logit(t) for t in texts], want, atol=1e-2, rtol=1e-4)


def test_training_is_repeatable_and_cut_is_best():
    texts, y = [t for _, t, _, _ in LABELLED[:100]], [y for *_, y in LABELLED[:100]]
    a, b = (Scorer(fit(texts, y, ["en"] * 100)).logit(texts[0]) for _ in range(2))
    assert a == b
    logits, labels = np.array([3.0, 2.0, 2.0, 1.0, 0.0]), np.array([1, 1, 0, 1, 0])
    assert best_cut(logits, labels, np.ones(5)) == 0.5
    assert best_cut(logits, labels, np.array([1, 1, 9, 1, 9])) == 2.5


def test_sample_is_bounded_and_spans_classes(spark):
    docs = spark.createDataFrame([(i, t, lang) for i, t, lang, _ in LABELLED] + [(5000, "x" * 30_000, "en")], "doc_id long, text string, lang string")
    texts, y, langs, shares = labelled_sample(docs, labels_of(spark, LABELLED, [(5000, 1, 1)]), "doc_id", "text", "lang", "toxic", rows=40)
    assert len(texts) <= 80 and 35 <= y.count(1) <= 40 and y.count(0) == 40 and set(langs) == {"en", "de"}
    assert shares[0] == sum(not held_out(i) and not y for i, _, _, y in LABELLED) / 40


def test_nothing_to_learn_and_empty_tables(spark, tmp_path):
    clean = [(i, t, lang, 0) for i, t, lang, _ in LABELLED[:20]]
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    assert {(r.score, r.predicted) for r in op12_convolutional_classifier(spark, tables(spark, tmp_path / "a", clean)).collect()} == {(0.0, 0)}
    write(documents(spark, []), tmp_path / "b", "documents")
    write(labels_of(spark, []), tmp_path / "b", "labels")
    assert op12_convolutional_classifier(spark, str(tmp_path / "b")).collect() == []


def words_in(units):
    """Each row's number of words, label and language, and the words' pieces in order."""
    found = []
    for u in units.collect():
        ids, pieces = np.frombuffer(u.ids, np.int32), np.frombuffer(u.pieces, np.int32).reshape(-1, 1 + len(toxicity.STEMS))
        start = 0
        for end, y, lang, kept in zip(np.frombuffer(u.ends, np.int64).tolist(), u.labels, u.langs, u.kept, strict=True):
            found.append((tuple(map(tuple, pieces[ids[start:end]].tolist())), y, lang, bool(kept)))
            start = end
    return sorted(found, key=repr)


def test_all_labelled_rows_are_learnt_from(spark, monkeypatch):
    rows = [*LABELLED, (5000, " ".join(f"long{i}" for i in range(20_000)), "en", 1), (5001, None, None, 0), (5003, "x y", "en", 1)]
    docs = spark.createDataFrame([(i, t, lang) for i, t, lang, _ in rows + LABELLED[:50]], "doc_id long, text string, lang string")
    want = sorted([(tuple(tuple(pieces_of(w)) for w in words_of((t or "").lower())) or ((BUCKETS,) * (1 + len(toxicity.STEMS)),), y, lang,
                    zlib.crc32((t or "").encode()) % toxicity.CALIBRATION == 0) for i, t, lang, y in rows if not held_out(i)], key=repr)
    assert len(want) > 500 and any(len(w) == 20_000 for w, *_ in want)
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 60)
    units = labelled_units(docs, labels_of(spark, rows), "doc_id", "text", "lang", "toxic")
    assert units.count() > 5 and words_in(units) == want
    total = units.agg(*[F.sum(c) for c in ("clean", "toxic", "kept_clean", "kept_toxic")]).first()
    assert sum(total) == len(want) and total[1] + total[3] == sum(y for _, y, *_ in want)
    net = fit_labelled(units)  # many units, averaged
    unseen = [r for r in LABELLED if held_out(r[0])]
    assert np.mean([(Scorer(net).logit(t) >= net.middle) == y for _, t, _, y in unseen]) >= 0.95
    again = fit_labelled(units.repartition(1))
    assert np.allclose(net.embedded, again.embedded) and again.thresholds == net.thresholds and again.middle == net.middle


def test_what_stands_in_long_texts_only_is_learnt(spark, tmp_path):
    def long_text(toxic):
        made = [f"w{RNG.randrange(300)}" for _ in range(5000)]
        return " ".join(made[:4000] + (["zonkwort"] if toxic else []) + made[4000:])

    rows = LABELLED + [(9000 + n, long_text(n % 2), "en", n % 2) for n in range(160)]
    found = {r.doc_id: r.score for r in op12_convolutional_classifier(spark, tables(spark, tmp_path, rows)).collect()}
    unseen = [(found[i], y) for i, _, _, y in rows[len(LABELLED):] if held_out(i)]
    assert len(unseen) > 20 and min(s for s, y in unseen if y) > max(s for s, y in unseen if not y)


def test_strongest_equals_brute_force_in_parts(monkeypatch):
    monkeypatch.setattr(toxicity, "AT_ONCE", 5)
    net, seen = first_network(), {}
    texts = ["", "a", "a b", " ".join(f"w{i % 17}" for i in range(40)), "x y z w v u"]
    unit = Unit.of([ids_of(t, seen) for t in texts], seen, [0, 1, 0, 1, 0], [False] * 5)
    assert np.allclose(unit_logits(net, unit, np.arange(5)), [brute_logit(net, t) for t in texts], atol=1e-5)
    place = np.concatenate([np.append(unit.rows(i), [-1, -1]) for i in range(5)])
    vectors = net.embedded[unit.pieces].sum(axis=1)
    best, spots = strongest(net.filters, vectors, place, np.cumsum(np.diff(unit.ends, prepend=0) + 2))
    for k, w in enumerate(net.filters):
        for f in range(FILTERS):
            at = spots[:, k * FILTERS + f]
            assert np.allclose(best[:, k * FILTERS + f], [sum(vectors[place[a + j]] @ w[j, :, f] for j in range(len(w))) for a in at], atol=1e-5)
    assert train(net, unit, (1.0, 1.0), 1, (0,)).embedded.shape == net.embedded.shape


def test_cuts_in_spark_equal_best_cut(spark):
    rng = random.Random(5)
    rows = [(rng.choice(("en", "de", "", None)), rng.randrange(2), round(rng.gauss(0, 1), 1) * rng.choice((1, 100))) for _ in range(400)]
    rows += [("fr", 1, 1.0)] * 20 + [("it", 1, 2.5)] * 8 + [("it", 0, 2.5)] * 8
    found = cuts(spark.createDataFrame(rows, "lang string, label long, logit double").repartition(3))
    assert set(found) == {None, "en", "de", "it"}
    for lang, cut in found.items():
        mine = [r for r in rows if lang is None or r[0] == lang]
        assert cut == pytest.approx(best_cut(np.array([r[2] for r in mine]), np.array([r[1] for r in mine]), np.ones(len(mine)))), lang


def test_passes_and_pieces():
    assert passes_of(560) == [1, 2, 3, 4] and passes_of(6000) == passes_of(10 ** 6) == [1, 1, 1, 1] and sum(passes_of(3000)) == 8
    for word in ("a", "word", "übermäßig", "longest_word", "漢字漢字漢"):
        want = [zlib.crc32(f"={word}".encode())] + [zlib.crc32(f"{n}{word[:n]}".encode()) for n in toxicity.STEMS if n < len(word)]
        assert pieces_of(word) == [x % BUCKETS for x in want] + [BUCKETS] * (1 + len(toxicity.STEMS) - len(want))
