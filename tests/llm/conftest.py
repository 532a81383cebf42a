import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs(spark):
    """A frame of documents from texts, or from (doc_id, text) or (doc_id, text, source)."""

    def make(rows, partitions=3):
        out = []
        for k, r in enumerate(rows):
            i, t, s = (*r, "s")[:3] if isinstance(r, tuple) else (k, r, "s")
            out.append((i, t, "en", s, None if t is None else len(t)))
        return spark.createDataFrame(out, DOCS).repartition(partitions)

    return make


@pytest.fixture(scope="session")
def prose():
    """Texts of invented words; n words from a vocabulary."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randrange(2, 10))) for _ in range(400)]

    def make(n, seed):
        r = random.Random(seed)
        return " ".join(r.choice(vocabulary) for _ in range(n))

    return make


#: Texts that operators must take as they come.
ODD_TEXTS = [None, "", " ", "\n\n \t", "one", "a b c", "x" * 5000, "word " * 30_000, "é ß 日本 \U0001f600 \u2581 \u200b", "\x00 \x1f", "same line\nsame line\n\nsame line", "\u00a0\u2003"]
