import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from texts, or from (doc_id, text) or (doc_id, text, source) rows."""

    def make(rows):
        full = []
        for i, row in enumerate(rows):
            row = (i, row) if row is None or isinstance(row, str) else row
            doc_id, text, source = (*row, "a")[:3]
            full.append((doc_id, text, "en", source, len(text or "")))
        return spark.createDataFrame(full, COLUMNS)

    return make


@pytest.fixture(scope="session")
def prose():
    """Texts of random words, the same for the same seed."""
    import random

    def make(words, seed, vocabulary=4000):
        rng = random.Random(seed)
        return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))

    return make


def awkward(prose):
    """Null, empty, blank, very long, repeated and tied rows."""
    long = prose(30_000, 1)
    same = prose(80, 2)
    return [
        (1, None), (2, ""), (3, " \t\n "), (4, long), (5, same), (6, same), (6, same), (7, "a"), (None, same),
        (None, None), (8, "x" * 50_000), (9, "é ü 😀 " * 30), (10, "9" * 3000), (11, "a@" * 2000), (12, "\n" * 500),
    ]


@pytest.fixture(scope="session")
def odd(documents, prose):
    return documents(awkward(prose))
