import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("fp", "score", "label", "key", "size", "part", "seq", "start", "id", "cell", "u", "c", "row", "component", "target", "taken", "a", "b")


def sentence(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="session")
def odd_rows():
    """Null and empty texts, one word, repeated rows and ids, a null id and source, odd white space, a very long text."""
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta", "iota", "rho"]
    long = " ".join(sentence(rng, words, 12) for _ in range(1800))
    body = sentence(rng, words, 60)
    return [
        (1, None, "en", "s1", 0),
        (2, "", "en", "s1", 0),
        (3, "word", None, None, 4),
        (3, "word", None, None, 4),
        (None, "Some text. Without an id", "en", "s2", 24),
        (4, " \t two\n\nwords \x0b", "fr", "s2", 10),
        (5, body, "fr", "s1", len(body)),
        (6, body, "fr", "s1", len(body)),
        (7, body.upper(), "fr", "s3", len(body)),
        (8, long, "en", "s1", len(long)),
        (9, "12345 !!! 67", "en", "s3", 12),
        (10, "ÄÖ ñandú <|endoftext|> 漢字   x", "de", "s3", 30),
        (11, "   ", "de", None, 3),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    d = spark.createDataFrame(odd_rows, SCHEMA).repartition(3)
    return d.withColumns({c: F.lit("extra") for c in CLASHING})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
