import pytest

#: A table with nulls in every column, empty and blank texts, ties, repeated rows and a clashing column.
ODD = [
    (1, "a b c d e f g h", "en", "x", 1, "s"),
    (2, None, None, None, None, None),
    (3, "", "en", "x", 0, "s"),
    (4, " \t\n", "en", "y", 3, "s"),
    (5, "A B C D E F G H", "en", None, 1, "s"),
    (5, "A B C D E F G H", "en", None, 1, "s"),
    (None, "a b c d e f g h", "en", "x", 1, "s"),
    (6, "één twéé\x00 😀 drie vier vijf", "nl", "z", 1, "s"),
    (7, "w " * 30_000, "en", "x", 1, "s"),
    (8, "x" * 100_000, "en", "x", 1, "s"),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size string"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, COLUMNS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
