import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, length string, id string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, extra columns with clashing names."""
    word = "ab's thé don't"
    rows = [
        (1, "Hello  world, it's 2024!", "en", "a", 24, "x", "y", "z"),
        (1, "Hello  world, it's 2024!", "en", "a", 24, "x", "y", "z"),
        (2, None, None, None, None, None, None, None),
        (3, "", "en", "a", 0, None, None, None),
        (None, "no id", "fr", None, 5, None, None, None),
        (4, " ".join([word] * 1500), "en", "b", 1, None, None, None),
        (4, " ".join([word] * 1500), "en", "b", 1, None, None, None),
        (5, "a" * 9000 + "b1" * 3000, "de", "b", 1, None, None, None),
        (6, " " * 5000 + "x" + "\n" * 5001 + "'" * 5000 + "s", "de", "b", 1, None, None, None),
        (7, "a<|endoftext|> b " + "漢字 😀 " * 2000, "de", "b", 1, None, None, None),
        (8, "Ᲊ" + "xy " * 4000, "de", "b", 1, None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
