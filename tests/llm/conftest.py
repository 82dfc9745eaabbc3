import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """A table of documents from (doc_id, text[, source])."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture
def prose():
    """Words drawn from a small vocabulary."""

    def make(n, seed, words=200):
        rng = random.Random(seed)
        vocabulary = ["".join(random.Random(i).choices("abcdefghijklmnop", k=2 + i % 6)) for i in range(words)]
        return " ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(words)], k=n))

    return make
