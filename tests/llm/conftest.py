import random

import pytest
from pyspark.sql import Row

BASE = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def base():
    return BASE


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("aeioubcdfgklmnprst") for _ in range(r.randint(2, 9))) for _ in range(n))


LONG = "\n".join(prose(s, 60) for s in range(400))
COMMON = "this very line is shared by several of the documents"
#: nulls in every column, empty and blank texts, a very long one, copies, near copies, repeated rows, a null id
ODD = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \n\t\x0b ", "en", None), (4, "one", None, "a"), (5, LONG, "en", "a"),
    (6, prose(1, 80), "en", "b"), (7, prose(1, 80), "fr", "b"), (8, prose(1, 80) + " end", "en", "b"),
    (9, prose(2, 70) + "\n" + COMMON, "en", "a"), (9, prose(2, 70) + "\n" + COMMON, "en", "a"), (10, COMMON.upper() + "\nsecond " + prose(3, 70), "en", "c"),
    (11, "  " + COMMON + "\t\n" + prose(4, 70) + "\n" + COMMON, "en", "c"), (12, prose(5, 90).title() + " Ünï 日本語 \U0001F600", "de", "b"),
    (13, "*** $$$ ### " * 40, "en", "a"), (14, "again and again " * 60, "en", "a"), (None, prose(6, 60), "en", "c"), (None, "nobody knows whose text this one is", None, "c"),
]


@pytest.fixture(scope="session")
def odd_rows():
    return ODD


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows with further columns, many of which have names that the operators use themselves."""
    schema = "doc_id long, text string, lang string, source string, size string, n_words string, kept string, items string, shard string, copies string, score string, id string, word string, key string"
    rows = [(*r, *["x"] * 10) for r in ODD]
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def empty(spark, odd):
    return odd.limit(0)


def as_rows(df):
    return [Row(**r.asDict()) for r in df.collect()]
