from __future__ import annotations

import random

import pytest

LONG = "The quick brown fox jumps over the lazy dog, again and again. " * 2000
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty and very long texts, ties and repeated rows, and columns of clashing names."""
    words = "alpha beta gamma delta eps zeta eta theta iota kappa".split()
    rng = random.Random(1)
    text = " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(120))
    rows = [
        (1, text, "en", "a", 5), (1, text, "en", "a", 5), (2, text, "en", "b", 5), (None, text, None, None, None), (None, None, None, None, None), (3, "", "fr", None, 0), (4, None, "de", "a", None),
        (5, LONG, "en", "b", len(LONG)), (6, "one", "en", "b", 3), (7, "été \U0001f600 naïve", "fr", "c", 11), (8, " \t\n ", None, "c", 4), (9, "1234 5678", None, "c", 9),
    ]
    rows = [(*r, i, "x", 1, 2) for i, r in enumerate(rows)]
    return spark.createDataFrame(rows, COLUMNS + ", _key long, _row string, size int, part int")


@pytest.fixture(scope="session")
def none(spark, odd):
    return odd.limit(0)


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
