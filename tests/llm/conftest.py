from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, n_words long, class_id string, added string"


@pytest.fixture(scope="session")
def odd(spark):
    """Null and empty texts, ties, repeated rows, a long text, nulls in every column, and columns with the names of results."""
    long = " ".join(f"w{i}x{i % 13}" for i in range(60_000))
    base = "One two three four five six seven eight nine ten eleven twelve thirteen.\nA second line with some words of its own, mail me at ann.lee@mail.example.com please"
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t ", None, "a", 4), (4, base, "en", "a", len(base)), (5, base, "en", None, len(base)),
        (6, base + " now", "en", "b", None), (7, long, "en", "a", len(long)), (8, "x", "fr", "b", 1), (8, "x", "fr", "b", 1), (9, "Größe 𝄞 naïve ñ — 漢字 \x00\x1c end", "de", "b", 30),
        (10, "\n".join([base] * 8), "en", "b", 900), (None, "a row without an id but with enough words to count as a text", "en", "c", 9),
    ]
    return spark.createDataFrame([(*r, 0.5, 7, 3, "c", "y") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
