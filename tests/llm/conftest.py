import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Makes a documents table; every text of the list is a row with doc_id 0, 1, ..."""

    def make(texts, ids=None, **more):
        rows = [(i, t, more.get("lang"), "src", None if t is None else len(t)) for i, t in zip(ids or range(len(texts)), texts)]
        return spark.createDataFrame(rows, COLUMNS)

    return make


@pytest.fixture
def awkward():
    """Null, empty, white, ties, repeats, other scripts, long."""
    return [None, "", " \t\n", "word", "word", "two words", "Éa ß 日本 😀 x", "a" * 5000, "lorem ipsum dolor sit amet " * 400, None, "lorem ipsum dolor sit amet " * 400]
