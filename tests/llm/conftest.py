import pytest
from pyspark.sql import functions as F

ODD_TEXTS = [
    (1, "one two three four five six seven", "en", "b"), (2, None, None, None), (3, "", "en", "a"), (None, "no id here at all", "en", "a"),
    (4, "one two three four five six seven", "en", "b"), (4, "one two three four five six seven", "en", "b"), (5, "   \n\t ", "xx", ""),
    (6, "long " * 30_000 + "end", "en", "c"), (7, "ÀÉÎ \u00a0 日本語 🙂", "fr", "b"), (8, "x" * 20_000, "en", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and extra columns whose names clash."""
    rows = spark.createDataFrame(ODD_TEXTS, SCHEMA)
    clash = ("size", "hash", "target", "copies", "key", "same", "rep", "group", "n", "row", "train", "words", "lines", "label", "features", "_row", "level", "kept", "_id", "_gone", "_base", "_part", "_found", "_gaps", "_key")
    return rows.withColumns({c: F.lit("clash") for c in clash}).cache()


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
