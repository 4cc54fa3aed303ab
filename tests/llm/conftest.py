from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names the operators use inside.
CLASHES = ("row", "part", "run", "label", "vector", "score", "n", "cid", "key", "__block", "text_key", "prefix")


@pytest.fixture(scope="session")
def table(spark):
    def make(rows, schema="doc_id long, text string"):
        return spark.createDataFrame(rows, schema)

    return make


@pytest.fixture(scope="session")
def edge_documents(spark):
    """Nulls, empty and long texts, repeated rows, ties, and columns with clashing names."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(50)]
    long = " ".join(rng.choice(words) for _ in range(30_000))
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "s", 0),
        (3, " \t\n", "en", "s", 3),
        (4, "one", "en", "s", 3),
        (5, "one two", "en", "s", 7),
        (6, "one  two", "en", "s", 8),
        (7, "One\ttwo", "de", "s", 7),
        (8, long, "en", "s", len(long)),
        (9, long + " tail", "en", "s", len(long)),
        (9, "repeated identifier", "en", "s", 19),
        (10, "repeated row 12345", "en", "s", 18),
        (10, "repeated row 12345", "en", "s", 18),
        (None, "no identifier", None, None, 13),
        (None, None, None, None, None),
        (11, "émigré ÄÖÜ 東京 \u0301 ﬁ", "fr", "s", 9),
    ]
    extra = tuple(range(len(CLASHES)))
    schema = SCHEMA + "".join(f", {c} int" for c in CLASHES)
    return spark.createDataFrame([r + extra for r in rows], schema)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def many_ranges(spark):
    """Keep all shuffle partitions, so that groups cross their edges."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
