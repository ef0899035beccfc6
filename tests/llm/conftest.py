import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, path string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and blank texts, a long one, ties, repeated rows, and columns whose names clash."""
    base = "the cat sat on the mat and looked at the small red bird in the old tree"
    rows = [
        (1, base, "en", "a", 1, 0.5, "x"),
        (2, base.upper(), "en", "a", 1, 0.5, "x"),
        (2, base.upper(), "en", "a", 1, 0.5, "x"),
        (3, base + " today", "en", "b", None, None, None),
        (4, None, None, None, None, None, None),
        (None, "   \n\t ", "de", "b", 3, 0.1, "y"),
        (5, "", "fr", None, 0, 0.1, "y"),
        (6, "ein kurzer Satz über die Straße 😀", "de", "c", 3, 0.1, "y"),
        (7, " ".join(f"word{i % 977}" for i in range(60_000)), "en", "c", 3, 0.1, "y"),
        (8, "une phrase courte où l'été dure", "fr", "c", 3, 0.1, "y"),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
