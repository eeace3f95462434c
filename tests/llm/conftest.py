from __future__ import annotations

import pytest

WORDS = "river stone amber quiet lantern gather morning silver window thread harbor cedar meadow copper signal orchard velvet timber candle bridge".split()


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", "s", ",", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def table(spark):
    """Documents with nulls, empty and long texts, repeated rows, ties, and columns whose names operators might use."""

    def make(rows):
        full = [(i, t, "en", "s", len(t or ""), 1.0, "x", 7) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, bucket int").repartition(3)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    long = prose(99, 6000)
    return [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, prose(5, 40)), (6, prose(5, 40)), (6, prose(5, 40)), (7, long), (8, "é" * 500), (None, prose(8, 30)), (9, "\U0001d54f math \U0001f600 " + prose(9, 12)), (10, "a\x00b c"), (11, "..., !!! ...")]
