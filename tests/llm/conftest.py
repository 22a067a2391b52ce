import pytest
from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node long, key string, size double, score string, kept boolean"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls everywhere, empty and long texts, ties, repeated rows, and columns named like inner ones."""
    words = [f"w{i}" for i in range(400)]
    long = " ".join(f"long{i % 997}x{i}" for i in range(60_000))
    rows = [
        (1, " ".join(words[:60]), "en", "a"), (2, " ".join(words[:60]), "en", "a"), (2, " ".join(words[:60]), "en", "a"), (3, " ".join(words[:58] + ["changed", "end"]), "en", None),
        (4, None, None, "b"), (5, "", "de", "b"), (6, " \n\t ", "de", "b"), (None, " ".join(words[100:160]), "fr", "b"), (7, " ".join(words[100:160]), None, "c"), (None, None, None, None),
        (8, "one", "en", "c"), (9, "ONE", "en", "c"), (10, "one two", "en", "c"), (11, long, "en", "d"), (12, long + " tail", "en", "d"), (13, "line a of text here\n\nline a of text here\nother line of this text", "en", "d"),
    ]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), 1, "k", 0.5, "s", True) for r in rows], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], T._parse_datatype_string(DOCS))
