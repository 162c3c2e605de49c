import random

import pytest
from pyspark.sql import types as T


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text) pairs, with further columns whose names clash with
    names that the operators use."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                           T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                           T.StructField("n_chars", T.LongType()), T.StructField("score", T.StringType()),
                           T.StructField("spans", T.StringType()), T.StructField("ord", T.StringType()),
                           T.StructField("fp", T.StringType()), T.StructField("row", T.StringType()),
                           T.StructField("words", T.StringType()), T.StructField("h", T.StringType())])

    def make(rows, lang="en"):
        return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t), "x", "y", "z", "w", "v", "u", "t")
                                      for i, t in rows], schema).repartition(3)
    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and blank texts, one letter, repeated rows, a repeated
    id, marks outside Latin-1, and a long text."""
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 8))) for _ in range(200)]
    long = " ".join(rng.choice(words) for _ in range(20000))
    return [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "x y"), (5, "x y"), (6, "x y"), (7, long), (8, long + " tail"),
            (None, "x y"), (None, None), (None, long), (9, "日本 語 \U0001F600 é"), (10, "NUL\x00 \x1c \x7f"), (11, "A" * 5000)]


def words_text(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))
