import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice("the of and to in is that it was for on are as with his they at be this from".split()) + (rng.choice(["", "ing", "ed", "s"])) for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty and long texts, repeated rows, odd characters."""
    rng = random.Random(5)
    base = prose(rng, 60)
    rows = [
        (1, None, "en", "a", None), (2, "", None, None, 0), (3, "   \t\n ", "en", "a", 6), (None, "text without an id", "en", "a", 18), (None, None, None, None, None),
        (4, "x" * 150_000, "en", "a", 150_000), (5, prose(rng, 9000), "en", "a", None), (6, base, "en", "a", 1), (6, base, "en", "a", 1), (7, base, "en", "b", 1),
        (8, base + " more", "en", "b", 1), (9, "É ñ ß 漢字   \x00 \xa0 end", "fr", "b", 1), (10, "!!! 123 ---", "xx", "b", 1), (11, "one", "en", "b", 1), (-3, "two words", "de", "c", 2),
    ]
    rows += [(100 + i, prose(rng, 40 + i), "en", "d", 1) for i in range(20)]
    return rows


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    """The rows with extra columns whose names clash with those of the operators."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(edge_rows, SCHEMA)
    clash = ("score", "kept", "part", "rep", "component", "component_id", "length", "key", "n", "segment", "digest", "held_out", "label", "drop", "b", "a", "own", "gone", "lost", "lines", "skerry_doc_id", "skerry_lines", "others", "blob")
    return df.select("*", *(F.lit(i).alias(c) for i, c in enumerate(clash)))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
