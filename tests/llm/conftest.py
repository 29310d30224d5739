import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, row_no string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns with clashing names."""
    base = " ".join(f"w{i}" for i in range(40))
    long = " ".join(f"Word{i % 977}" for i in range(30_000))
    rows = [(1, base, "en", "a", 3, 0.5, 7, "x"), (2, base, None, "a", 3, None, None, None), (2, base, None, "a", 3, None, None, None), (3, None, None, None, None, None, None, None),
            (4, "", "en", "b", 0, 0.0, 0, ""), (5, " \t\n", "en", "b", 3, 0.0, 0, ""), (None, "no id here", "en", "b", 3, 0.0, 0, ""), (6, long, "en", "c", len(long), 0.0, 0, ""),
            (7, base.replace("w5 ", "other "), "en", "a", 3, 0.0, 0, ""), (8, "One two", "en", "a", 3, 0.0, 0, ""), (9, "one TWO", "en", "a", 3, 0.0, 0, "")]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
