import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from salesdeck.llm.spelling import last_forms, near_words, neighbourhood, op11_reduced_alphabet, reduced, variants, word_counts

from .helpers import EDGES, documents, prose, write

LETTERS = [chr(x) for x in [*range(0x61, 0x7B), *range(0xC0, 0x100)]]


def edits(w, letters=LETTERS):
    cut = [(w[:i], w[i:]) for i in range(len(w) + 1)]
    return {a + b[1:] for a, b in cut if b} | {a + x + b[1:] for a, b in cut if b for x in letters} \
        | {a + x + b for a, b in cut for x in letters}


def brute_words(rows):
    counts = Counter()
    for i, t, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(x.lower() if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def brute(counts):
    form, near = {}, {}
    for w, n in counts.items():
        others = [x for x in edits(w) - {w} if x in counts]
        near[w] = len(others)
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, near[w], counts[form[w]] if form[w] else None))
    return out


def words_like(rng, stems):
    w = rng.choice(stems)
    for _ in range(rng.choice((0, 0, 0, 1, 1, 2))):
        w = rng.choice(sorted(edits(w, "abéÿ×n")))
    return w if rng.random() < 0.8 else w.capitalize()


RNG = random.Random(5)
STEMS = ["garden", "gardens", "éclair", "straße", "àÿþðü", "abcde", "abcdf", "mississippi", "aaaaa", "aaaaaa", "zzzzzz"]
ROWS = EDGES + [(100 + i, " ".join(words_like(RNG, STEMS) for _ in range(RNG.randrange(1, 120))) + ".,\n 12x", "a") for i in range(150)] \
    + [(900, "ÉCLAIR éclair Éclair ÀBCDE", "a"), (901, "hotword " * 5000, "a"), (902, "hotwords hotwordz otword " * 40, "b"),
       (903, prose(3, 50).replace("w", "wörter"), "a")]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_query_equals_brute_force(spark, tmp_path):
    made = op11_reduced_alphabet(spark, write(documents(spark, ROWS), tmp_path, "documents"))
    want = brute(brute_words(ROWS))
    assert made.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert rows_of(made) == sorted(want, key=repr)
    assert sum(r[2] != r[0] for r in want) > 50 and any(r[1] is not None and r[1] != r[2] for r in want)


def test_any_alphabet_gives_the_same(spark):
    counts = brute_words(ROWS)
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    for symbols in (1, 2, 9):
        assert rows_of(variants(words, symbols)) == sorted(brute(counts), key=repr), symbols


def test_neighbourhood_is_whole(spark):
    codes = spark.createDataFrame([("a",), ("ba",), ("abcab",), ("aaaaaaa",)], "code string")
    made = codes.select("code", F.size(neighbourhood(F.col("code"), 3)).alias("n")).collect()
    assert {r.code: r.n for r in made} == {c: len(edits(c, "abc") | {c}) for c in ("a", "ba", "abcab", "aaaaaaa")}
    assert codes.select(reduced(F.lit("é" + "xyz"), 4).alias("r")).first().r == "".join("abcd"[zlib.crc32(x.encode()) % 4] for x in "éxyz")


def test_words_are_counted_before_the_shuffle(spark):
    counted = word_counts(documents(spark, [(i, "hotword " * 50, "a") for i in range(400)]), slips=10**9)
    assert rows_of(counted) == [("hotword", 20_000)]


def test_long_chains_settle(spark):
    chain = spark.createDataFrame([(f"w{i:03}", f"w{i + 1:03}") for i in range(100)] + [(f"x{i}", "w000") for i in range(40)],
                                  "word string, form string")
    assert {r.root for r in last_forms(chain).collect()} == {"w100"}


def test_no_word_meets_itself_and_ties_go_to_the_least(spark):
    words = spark.createDataFrame([("hotel", 5), ("hotea", 10), ("hoteb", 10), ("motel", 5)], "word string, n long")
    got = {r.word: (r.form, r.root, r.n_near) for r in variants(words).collect()}
    assert got == {"hotel": ("hotea", "hotea", 3), "hotea": (None, "hotea", 2), "hoteb": (None, "hoteb", 2), "motel": (None, "motel", 1)}
    assert near_words(words).filter("word = other").count() == 0


def test_empty_table(spark, tmp_path):
    assert op11_reduced_alphabet(spark, write(documents(spark, []), tmp_path, "documents")).collect() == []
