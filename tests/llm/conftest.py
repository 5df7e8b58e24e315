import random

import pytest

SCHEMA = "doc_id long, text string, source string, n_chars long, spans string, kept int, score double, row int"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns with names the operators use."""
    rng = random.Random(1)
    long = "\n".join(" ".join(words(rng, 40)) for _ in range(300))
    rows = [
        (1, None, "a", None),
        (2, "", "a", 0),
        (3, " \n\t ", None, 3),
        (4, "one", "b", 3),
        (5, "one", "b", 3),
        (None, "no id here but a text of some words", "b", 5),
        (None, None, None, None),
        (6, long, "a", len(long)),
        (7, "été 日本語 \U0001f600 mot\n\nmot", "c", 4),
        (8, " ".join(words(rng, 80)), "a", 1),
        (8, " ".join(words(rng, 80)), "a", 1),
        (9, "same words of one row again", "c", 2),
        (9, "same words of one row again", "c", 2),
    ]
    return spark.createDataFrame([(*r, "x", 1, 0.5, 7) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
