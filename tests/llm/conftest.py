import random

import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Rows as ``documents``: nulls, empty texts, ties, repeats and a clashing extra column."""
    def build(rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
        return spark.createDataFrame(
            [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], schema)
    return build


@pytest.fixture(scope="session")
def prose():
    """Made-up sentences from a seed."""
    def write(seed, n, vocabulary=4000):
        draw = random.Random(seed)
        return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(n))
    return write


@pytest.fixture(scope="session")
def edge_rows(prose):
    """One table for the cases that every operator must take."""
    long = " ".join([prose(1, 3000), "zz " * 500, prose(2, 3000)])
    return [
        (1, "Plain words here. " + prose(3, 40), "a"), (2, None, "a"), (3, "", None),
        (4, " \t\n", "b"), (None, "Plain words here. " + prose(3, 40), "b"),
        (5, long, "c"), (5, long, "c"), (6, "one", None), (None, None, None),
        (7, "Ünïcödé Straße ÉTÉ " + prose(4, 30), "é"), (8, prose(5, 60), "a"),
        (9, prose(5, 60), "a"), (9, prose(6, 25), "a"),
    ]
