import hashlib
from collections import defaultdict

import pytest
import xxhash

from salesdeck.llm.exact_dedup import drop_exact, op10_exact_dedup
from salesdeck.llm.simhash import drop_near, fingerprint, op8_simhash_near_dedup, segments

from .helpers import EDGES, documents, prose, write

SPACE = str.maketrans("", "", " \t\n\x0b\f\r")


def exact_by_hand(rows):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[(t or "").translate(SPACE)].append((i, t or ""))
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        first = True
        for i, t in members:
            kept = (i, len(t)) == (keep[0], len(keep[1])) and first
            first = first and not kept
            out.append((i, keep[0], len(members), kept, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


ROWS = EDGES + [(20 + i, prose(5, 60).replace(" ", "  " if i % 3 else " "), "a") for i in range(40)] \
    + [(100 + i, prose(5, 60)[:-1] + str(i), "a") for i in range(10)]


def test_exact_groups_against_brute_force(spark, tmp_path):
    folder = write(documents(spark, ROWS), tmp_path, "documents")
    got = sorted(map(tuple, op10_exact_dedup(spark, folder).collect()), key=repr)
    assert got == exact_by_hand(ROWS)


def test_a_full_bitmap_changes_nothing(spark):
    from salesdeck.llm.exact_dedup import exact_groups
    df = documents(spark, ROWS)
    a = exact_groups(df, ["doc_id"]).collect()
    b = exact_groups(df, ["doc_id"], bitmap_bits=32, prefix=1).collect()
    assert sorted(map(repr, a)) == sorted(map(repr, b))


def test_drop_exact_keeps_columns_and_one_of_each(spark):
    df = documents(spark, ROWS)
    kept = drop_exact(df)
    assert kept.columns == df.columns and dict(kept.dtypes) == dict(df.dtypes)
    texts = [(r.text or "").translate(SPACE) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({(t or "").translate(SPACE) for _, t, _ in ROWS})


def slow_fingerprint(text, shingle=4):
    words = [w for w in __import__("re").split("[ \t\n\x0b\f\r]+", "".join(
        c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_by_hand(rows, distance=4):
    fps = [slow_fingerprint(t) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted(((doc, f"{fps[i]:016x}", least.get(root(i))) for i, (doc, _, _) in enumerate(rows)), key=repr)


def near_rows():
    rows = [r for r in EDGES if r[0] != 7]
    for g in range(6):
        words = prose(50 + g, 300).split()
        for c in range(8):
            changed = list(words)
            changed[10 * c % 300] = f"x{c}"
            changed[(37 * c + 5) % 300] = changed[(37 * c + 5) % 300].upper()
            rows.append((200 + 10 * g + c, " ".join(changed), "a"))
    return rows + [(400 + i, prose(900 + i, 5), "b") for i in range(30)]


@pytest.mark.parametrize("text", [None, "", "one", "A b c", "A b c D", prose(3, 500), "É b\x0bc d e f"])
def test_fingerprint(text):
    assert fingerprint(text, 4) % (1 << 64) == slow_fingerprint(text)


def test_near_duplicates_against_brute_force(spark, tmp_path):
    rows = near_rows()
    folder = write(documents(spark, rows), tmp_path, "documents")
    got = sorted(map(tuple, op8_simhash_near_dedup(spark, folder).collect()), key=repr)
    want = near_by_hand(rows)
    assert got == want
    assert len({c for _, _, c in want}) < len(rows) - 20  # there is something to find


def test_links_at_every_distance(spark):
    """A chain of fingerprints whose neighbours differ by exactly 4 or 5 bits, wherever the bits lie."""
    import random
    from salesdeck.llm.simhash import links
    rng = random.Random(4)
    fps = [rng.getrandbits(64) for _ in range(150)]
    fps += [f ^ sum(1 << b for b in rng.sample(range(64), 1 + i % 5)) for i, f in enumerate(fps)]
    signed = [f - (1 << 64) if f >> 63 else f for f in set(fps)]
    got = {tuple(sorted((r.a, r.b))) for r in links(spark.createDataFrame([(f,) for f in signed], "fp long"), 4).collect()}
    want = {tuple(sorted((a, b))) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4}
    assert got == want and len(want) >= 110
    assert [w for _, w in segments(4)] == [21, 21, 22]


def test_components_of_a_long_chain_and_a_star(spark):
    from salesdeck.llm.simhash import components
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 80)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(80)}}


def test_drop_near_keeps_one_of_each(spark):
    rows = near_rows()
    df = documents(spark, rows)
    kept = drop_near(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    want = {c for _, _, c in near_by_hand(rows)}
    assert sorted(ids, key=repr) == sorted(want, key=repr)


def test_empty_tables(spark):
    empty = documents(spark, [])
    assert drop_exact(empty).count() == 0 and drop_near(empty).count() == 0
