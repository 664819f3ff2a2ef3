"""Small tables with every odd case: nulls, empty and long texts, ties, repeated rows, clashing names."""

import random

import pytest

ODD = [(1, None), (2, ""), (3, "   \n"), (None, "one two three"), (4, "one two three"), (5, "one two three"), (5, "one two three"), (6, "!!! 123"), (7, "long " * 20_000)]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, "x", 1, 0.5, "fp") for i, t in ODD]
    shape = "doc_id long, text string, lang_pred string, n_tokens int, score double, found string"
    return spark.createDataFrame(rows, shape)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    letters = "abcdefghijklmnop"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(vocabulary)]
    return " ".join(rng.choice(words) for _ in range(n))
