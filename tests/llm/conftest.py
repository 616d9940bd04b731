import pytest

MESSY = [
    (1, None), (2, ""), (3, "   \t\n "), (4, "one"), (5, "one"), (5, "one"), (6, "Two  words"), (7, "two words"), (None, "one"),
    (None, None), (8, "é ü 日本語 😀\n" * 40), (9, "a" * 200_000), (10, "x " * 60_000), (11, "\n" * 5000), (12, "\x00 \x01\x02"),
    (13, "1 " * 5000), (14, "Released under the MIT License."), (15, "a.b@c.de " * 300),
]


@pytest.fixture(scope="session")
def messy(spark):
    """Null ids and texts, empty and blank texts, repeated rows, ties, very long texts, clashing further columns."""
    rows = [(i, t, "en" if t else None, k, "x") for k, (i, t) in enumerate(MESSY)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, row long, score string").repartition(3)


@pytest.fixture(scope="session")
def nothing(messy):
    return messy.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(4)


@pytest.fixture(scope="session")
def pdocs(docs):
    return docs.toPandas()
