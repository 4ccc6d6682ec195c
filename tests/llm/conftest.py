import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, copies string, row string, key string, n_lines int, score string, path string"
TEXTS = [
    None,
    "",
    "   ",
    "\n\n",
    "one",
    "one two three four",
    "Ünïcode wörds ß and 日本語 ✓ mixed in\nlines",
    "<|endoftext|> stays <|endoftext|>",
    "mail a@b.com, ip 10.0.0.1, call +1 (212) 555-0199, card 4111 1111 1111 1111",
    "word " * 40_000,
    "x" * 100_000,
    "same text for a tie\nshared line",
    "same text for a tie\nshared line",
]


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and very long texts, ties, repeated rows, a repeated id."""
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"s{i % 3}", None, 1, "c", None, "k", 2, "s", "p") for i, t in enumerate(TEXTS)]
    rows += [rows[-1], rows[-1], (None, "same text for a tie\nshared line", None, None, None, None, None, None, None, None, None, None), (5, "another text under a used id", "en", "s1", 3, 1, "c", "r", "k", 2, "s", "p")]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def words():
    """Sentences from a small language, by seed."""

    def make(seed: int, n: int, stems: str = "ka mo ti re lu sa ne vo") -> str:
        r, parts = random.Random(seed), stems.split()
        return " ".join("".join(r.choice(parts) for _ in range(r.randrange(1, 4))) for _ in range(n))

    return make
