import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def docs(duck):
    return duck.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, short and very long texts, ties, repeated rows, extra columns with names that helpers use."""
    long_text = " ".join(f"w{i * 7919 % 10007}" for i in range(60_000))
    rows = [
        (1, "One two three four five, six seven eight nine ten; eleven twelve thirteen.", "en", "a", 10),
        (2, "One two three four five, six seven eight nine ten; eleven twelve thirteen.", "en", "b", 10),
        (2, "One two three four five, six seven eight nine ten; eleven twelve thirteen.", "en", "b", 10),
        (3, None, "en", None, None),
        (4, "", None, "a", 0),
        (None, "a text without an id", "en", "a", 3),
        (None, None, None, None, None),
        (5, " \t\n ", "de", "", 4),
        (6, long_text, "fr", "c", len(long_text)),
        (7, "ab", "en", "c", 2),
        (8, "Ünïcode ✓ " * 30, "en", "c", 300),
        (9, "x <|endoftext|> y \x1c z   \n\n end", "en", "d", 3),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = ["size", "rate", "score", "fp", "chunk", "times", "copy", "area", "_n", "tile", "target", "x", "kept_id", "length", "part"]
    return frame.withColumns({c: F.lit(7) for c in clash})


@pytest.fixture(scope="session")
def odd_rows(odd):
    return [(r["doc_id"], r["text"]) for r in odd.collect()]
