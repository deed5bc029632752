"""Small hand-made tables: nulls, empty and long texts, ties, repeated rows, clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed: int, n: int) -> str:
    rng = random.Random(seed)
    parts = ["an", "be", "ci", "do", "er", "fo", "gu", "hi", "ko", "lu", "mi", "no"]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


LONG = words(1, 30_000)
PASSAGE = "shared passage: " + words(2, 60)
NEAR = words(3, 200).split(" ")

ROWS = [
    (0, words(10, 120) + "\n" + PASSAGE, "en", "a"),
    (1, words(11, 80) + "\n" + PASSAGE + "\n" + words(12, 30), "en", "b"),
    (2, None, "en", "a"),
    (3, "", None, None),
    (4, " \t\n ", "de", "a"),
    (5, "one two", "de", "b"),
    (6, "One  TWO", "de", "b"),
    (7, LONG, "fr", "c"),
    (8, " ".join(NEAR), "fr", "c"),
    (9, " ".join(NEAR[:100] + ["changed"] + NEAR[101:]), None, "c"),
    (10, " ".join(NEAR[:100] + ["changed"] * 40 + NEAR[140:]), "fr", None),
    (11, " ".join(NEAR), "fr", "a"),
    (12, "ab" * 700, "es", "é"),
    (13, "été 日本語 🎉 <|endoftext|> don't   \n\n  end x", "es", "é"),
    (14, "same line here\nsame line here\n  SAME LINE HERE \nshort", "es", "a"),
    (15, "same line here\nother", "es", "b"),
    (15, "same line here\nother", "es", "b"),
    (None, "same line here\n" + PASSAGE, "en", "b"),
]


def documents(spark, rows=None):
    rows = ROWS if rows is None else rows
    return spark.createDataFrame([(i, t, g, s, None if t is None else len(t)) for i, t, g, s in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(spark, *names):
    """The same rows with extra columns named like results and like inner names."""
    from pyspark.sql import functions as F

    df = documents(spark)
    for n in (*names, "id", "hash", "n", "part", "start", "size", "component", "no", "round", "words"):
        df = df.withColumn(n, F.lit("x"))
    return df
