from __future__ import annotations

import random

import pytest

WORDS = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in ("n", "r", "st", "l")]
#: Every table may have these: clashing names, nested values.
EXTRA = "key string, part int, window string, members array<int>, " + ", ".join(f"{c} int" for c in ("rep", "n", "at", "_both", "_verdict", "_source", "_epochs", "_times", "_doc", "_cuts", "_gone", "gone", "_html", "_id", "_text", "pid", "source_", "d", "g"))
_NONE = (None,) * 19


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture
def awkward(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, columns with clashing names."""
    rng = random.Random(1)
    long = prose(rng, 30_000)
    base = prose(rng, 120)
    rows = [
        (1, base, "en", "a", 10, "k", 1, "w", [1]), (1, base, "en", "a", 10, "k", 1, "w", [1]), (2, base, "en", "a", 10, None, None, None, None), (3, base + " " + prose(rng, 5), "en", "b", 11, None, None, None, None),
        (4, "", None, "a", 0, None, None, None, None), (5, None, None, None, None, None, None, None, None), (6, " \n\t ", "en", "b", 3, None, None, None, None), (7, long, "en", "b", 9, None, None, None, None), (None, prose(rng, 80), "en", None, 5, None, None, None, None),
        (8, "é ß 😀 日本語 ıİ", "xx", "c", 5, None, None, None, None), (9, "word", "en", "c", 4, None, None, None, None), (10, "word", "en", "c", 4, None, None, None, None), (None, None, None, None, None, None, None, None, None),
    ]
    rows = [(*r, *_NONE) for r in rows]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}")


@pytest.fixture
def empty(awkward):
    return awkward.filter("false")
