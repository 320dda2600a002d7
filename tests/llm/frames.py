"""Small frames with the awkward cases that every operator must take."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# columns that operators use inside, as extra columns of the input
CLASHES = ("id", "n", "host", "hot", "label", "fold", "score", "row", "tie", "component", "key", "words", "lines_dropped", "values_changed", "a.b")


def prose(seed: int, n: int = 60) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(["an", "tion", "er", "the", "ou", "st", "ble"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def awkward(spark, rows=()):
    """Documents with nulls in every column, empty, blank and very long texts, repeated rows and ids."""
    base = [
        (1, prose(1), "en", "s1", 5), (1, prose(1), "en", "s1", 5), (2, None, "en", "s1", None), (3, "", None, "s1", 0), (4, " \n\t ", "de", None, 4),
        (None, prose(2), "en", "s1", 5), (None, None, None, None, None), (5, prose(3, 30_000), "fr", "s2", 9), (6, "x" * 40_000, "es", "s2", 9),
        (7, "one two", "en", "s2", 7), (7, "other words altogether here now", "en", "s2", 7), *rows,
    ]
    return spark.createDataFrame(base, DOCS)


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(f"extra {c}").alias(c) for c in CLASHES])


def empty(spark):
    return spark.createDataFrame([], DOCS)
