import pytest

#: Columns of documents, and more whose names the operators use inside or return.
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, keep_id long, id string, _h string, kept int, _row int, host string, _gone long, part int, _null int"


@pytest.fixture(scope="session")
def docs(spark):
    def make(rows, sources=None):
        """documents from (doc_id, text) pairs."""
        sources = sources or ["s"] * len(rows)
        return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for (i, t), s in zip(rows, sources)], "doc_id long, text string, lang string, source string, n_chars long")

    return make


@pytest.fixture(scope="session")
def clashing(spark):
    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, "x", "y", 1, 2, "z", 3, 4, 5) for i, t in rows], CLASHING)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, blank and very long texts, ties and repeated rows."""
    long = " ".join(f"w{k % 977}x{k}" for k in range(60_000))
    return [(1, None), (2, ""), (3, "   \n\t "), (4, long), (5, long), (6, "a b c"), (7, "a b c"), (8, "A b c"), (9, "é ß 漢字 😀"), (10, None), (10, None), (11, "a b c\n")]
