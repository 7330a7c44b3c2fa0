from __future__ import annotations

import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"

#: nulls, empty and short texts, repeated rows, repeated ids, a null id, copies, a long text
EDGE = [
    (1, "one two three four five six seven eight nine ten eleven twelve"),
    (2, "one two three four five six seven eight nine ten eleven twelve"),
    (2, "one two three four five six seven eight nine ten eleven twelve"),
    (3, None), (4, ""), (5, "  \n\t "), (6, "word"), (7, "Word"), (8, "two words"),
    (9, "ONE TWO THREE FOUR FIVE SIX SEVEN EIGHT NINE TEN ELEVEN TWELVE thirteen"),
    (10, "naïve café 漢字 ١٢ it's 42 <|endoftext|> ..."),
    (10, "another text under the same id with some more words in it"),
    (None, "a text without an id that nobody else has at all"),
    (None, "one two three four five six seven eight nine ten eleven twelve"),
    (11, "x" * 150), (12, "x" * 150 + " y"),
    (13, " ".join(f"w{i % 997}" for i in range(60_000))),
]


@pytest.fixture(scope="session")
def edge_rows():
    return EDGE


@pytest.fixture(scope="session")
def edge_docs(spark):
    """The edge rows with extra columns named like the operators' own."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, class string, size int, tkey string, h int, words string"
    rows = [(i, t, None, "s", len(t or ""), "c", 1, "k", None, "w") for i, t in EDGE]
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def tiny_labels(spark):
    return spark.createDataFrame([(1, 1, 0), (9, 1, 0), (6, 0, 1), (8, 0, 1), (None, 1, 1), (3, None, None), (1, 1, 0)],
                                 T._parse_datatype_string("doc_id long, quality int, toxic int"))


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
