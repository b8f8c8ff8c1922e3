"""Documents with everything that may go wrong, for every operator."""

from __future__ import annotations

import random

import pytest

EXTRA = "doc_id bigint, text string, lang string, k bigint, id string, rep int, r string, t double, at int, n bigint, len int, few int, tied binary, wk bigint"


@pytest.fixture(scope="session")
def prose():
    """``prose(n, seed)``: n invented words."""

    def make(n: int, seed: int = 0, words: int = 3000) -> str:
        g = random.Random(seed)
        return " ".join("".join(g.choice(("ba", "ne", "ti", "so", "ru", "kel", "mor", "vi")) for _ in range(1 + g.randrange(words) % 4)) + g.choice(("", "", "", ".", ",")) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def odd_rows(prose):
    """Nulls, empties, repeats, ties, a very long text and columns whose names the operators use themselves."""
    texts = [
        (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, prose(300, 1)), (5, prose(300, 1)), (6, prose(300, 1)), (None, prose(300, 2)), (None, prose(300, 2)), (None, None),
        (7, "naïve Ünïcode — 漢字 \U0001f600 " * 30), (8, prose(30_000, 3)), (9, prose(300, 4)), (9, prose(300, 5)), (10, "x" * 50_000), (-3, prose(120, 6)), (11, "\x00\x01 a b"),
    ]
    return [(i, t, None if n % 3 else "en", n, str(n), n, "r", 0.5, n, n, n, n, b"x", n) for n, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    from quirespark.session import ship

    return ship(spark).createDataFrame(odd_rows, EXTRA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], EXTRA)


@pytest.fixture(scope="session")
def docs(spark, small):
    from quirespark.session import ship

    return ship(spark).read.parquet(f"{small}/documents.parquet")
