import random
import re

import pytest
from pyspark.sql import types as T

WORDS = re.compile(r"[^\x20\x09-\x0D]+")

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that operators use for columns of their own.
        *(T.StructField(x, T.StringType()) for x in ("score", "key", "row", "fp", "anchors", "length", "y", "_row", "a.b `c")),
    ]
)


def sentence(rng, n, stock=400):
    return " ".join(f"w{rng.randrange(stock):x}ab" for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties and repeated rows."""
    rng = random.Random(5)
    shared, own = sentence(rng, 60), [sentence(rng, 80) for _ in range(12)]
    texts = [
        (None, "a text without an id"),
        (1, None),
        (2, ""),
        (3, " \t\n "),
        (4, own[0]),
        (4, own[0]),
        (5, own[0]),
        (6, own[1] + "\n" + shared + "\n" + own[2]),
        (7, own[3] + " " + shared),
        (8, "same word " * 50),
        (9, "Ünïcödé ÉTÉ ß straße " + own[4]),
        (10, "x" * 150_000 + " " + own[5]),
        (11, " ".join(sentence(rng, 100, 5000) for _ in range(150))),
        (12, own[6] + "\r\n\r\n" + own[6]),
        (13, "one two three"),
        (14, "\x0b\x0cone\x1ctwo\x85three\xa0four"),
        (None, None),
    ]
    return [(i, t, None if i == 7 else "en", None if i == 6 else "s", None, *["z"] * 9) for i, t in texts]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
