import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, ties, and columns with clashing names."""
    long = " ".join(f"word{i % 977} and more" for i in range(9000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog and runs away from it.", "en", "a", 1),
        (1, "The quick brown fox jumps over the lazy dog and runs away from it.", "en", "a", 1),
        (2, None, "fr", "a", None),
        (3, "", None, "b", 0),
        (4, "  \n\t ", "de", None, 5),
        (5, "!!! ??? ---", "en", "b", 9),
        (6, long, "en", "a", len(long)),
        (7, "x", "es", "a", 1),
        (None, "A row without a key, password = hunter2hunter2.", None, None, None),
        (None, None, None, None, None),
        (8, "Ünïcode wörds 日本語 and ſpecial K signs \U0001f600 token: abcdefgh12", "de", "a", 3),
    ]
    extra = [r + (0.5, "clash", [1], "r") for r in rows]
    return spark.createDataFrame(extra, SCHEMA + ", score double, secrets string, found array<int>, row string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
