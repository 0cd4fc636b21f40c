import pandas as pd
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string, th string, text_hash int, words string"


@pytest.fixture(scope="session")
def documents(spark):
    """Make a documents table from (doc_id, text) pairs, with further columns whose names clash with inner ones."""

    def make(rows):
        full = [(i, t, "en", "s", None if t is None else len(t), None, "x", 1, "y") for i, t in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def corpus():
    return pd.read_parquet("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"])


@pytest.fixture(scope="session")
def small_dir(tmp_path_factory):
    """The smallest tables by another path, as queries get it."""
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and very long texts, ties and rows that repeat."""
    long = "lorem ipsum dolor sit amet " * 5000
    return [(1, None), (2, ""), (3, "  \n\t "), (4, long), (5, "one two three four five six seven"), (6, "one two three four five six seven"), (6, "one two three four five six seven"), (None, "one two three four five six seven"), (None, None), (7, "Ü" * 500)]
