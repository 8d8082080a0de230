"""Small tables with the awkward cases that every operator must take."""

import random

import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int, words: str = "the of and to in was he it for on with as his at by from they we say her she or an will my one all would there") -> str:
    pick = random.Random(seed)
    return " ".join(pick.choice(words.split()) + str(pick.randint(0, 400)) for _ in range(n))


def awkward_rows() -> list[tuple]:
    """Nulls in every column, empty and blank texts, a very long text, one huge word, ties, repeated rows."""
    long = prose(1, 30_000)
    rows = [
        (1, None, "en", "a", None),
        (2, "", None, "a", 0),
        (3, " \n\t ", "en", None, 4),
        (4, long, "en", "b", len(long)),
        (5, "x" * 50_000, "de", "b", 50_000),
        (6, "one two", "en", "a", 7),
        (6, "one two", "en", "a", 7),
        (7, "one two", "en", "a", 7),
        (None, "no id here at all", "en", "a", 17),
        (8, prose(2, 60), "fr", "c", None),
        (9, prose(2, 60), "fr", "c", None),
        (10, "é ü 日本 \U0001f642   \x0b ok", None, "", 5),
    ]
    return rows


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def clashing(awkward):
    """Further columns named like those that operators make."""
    from pyspark.sql import functions as F

    names = ("_row", "_text", "size", "row", "n_words", "label", "shard", "slot", "text_crc32", "_source", "_size", "_key", "_bucket", "_host", "_page", "same", "n", "a", "b", "rep", "spans", "times", "target", "piece", "length", "sequence_id", "offset", "score", "bad", "fold", "_s")
    return awkward.select("*", *[F.lit(7).alias(x) for x in names])
