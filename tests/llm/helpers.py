"""Small document tables for the corpus operators."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names the operators might use themselves.
CLASHING = ("id", "size", "digest", "length", "content", "salt", "first", "number", "word", "doc", "host", "group")


def documents(spark, rows, clash=True):
    """Rows of (doc_id, text, source); all other columns are filled in."""
    names = CLASHING if clash else ()
    schema = SCHEMA + "".join(f", `{c}` string" for c in names)
    data = [(i, t, "en", s, None if t is None else len(t), *[f"{c}!" for c in names]) for i, t, s in rows]
    return spark.createDataFrame(data, schema)


def prose(seed, words, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))


#: Nulls, empty and very long texts, ties, repeated rows, odd white space.
EDGES = [(1, None, "a"), (2, "", "a"), (3, " \t\n", None), (4, "one", "b"), (5, "one", "b"), (5, "one", "b"),
         (None, "two words", "b"), (7, prose(1, 30_000), "a"), (8, "é" * 50 + " \x0b x\r\n y", ""), (9, prose(2, 80), None),
         (10, prose(2, 80) + "\n", None), (11, "a  b   c \n d\n\n e  f", "b")]


def write(df, folder, table):
    df.write.parquet(f"{folder}/{table}.parquet")
    return str(folder)
