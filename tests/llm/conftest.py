import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from helpers import SCHEMA, prose  # noqa: E402


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in each column, empty and long texts, ties, repeated rows, and columns whose names the operators use inside."""
    r = random.Random(1)
    long = prose(r, 20_000)
    rows = [
        (1, prose(r, 120), "en", "a", 1),
        (1, prose(r, 80), "en", "a", 1),
        (2, None, "en", "a", None),
        (3, "", "en", None, 0),
        (4, " \t\n\x0b\x0c\r ", None, "a", 7),
        (None, prose(r, 60), "de", "b", 3),
        (None, prose(r, 60), "de", "b", 3),
        (5, long, "en", "hot", 5),
        (6, "same text here for a tie", "en", "hot", 5),
        (7, "same text here for a tie", "en", "hot", 5),
        (7, "same text here for a tie", "en", "hot", 5),
        (8, "x", "en", "hot", 5),
        (9, "ünï cödé 😀 　 Ⅷ <|endoftext|> z", "fr", "hot", 5),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F

    # Names that clash with those of operators' own columns.
    return df.withColumns({c: F.lit("clash") for c in ("key", "row", "size", "keys", "grp", "score", "kept", "length", "piece", "symbols", "edits2", "word", "_q2")})


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
