import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table from (doc_id, text) or (doc_id, text, source) rows; other columns follow from them."""

    def make(rows):
        return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def odd(make_docs):
    """Null and empty texts, null ids and sources, a repeated row, a long text and one without words."""
    long = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
    return make_docs([(1, None, "a"), (2, "", None), (None, "some plain words here", "b"), (4, "two", "a"), (4, "two", "a"), (5, long, "b"), (6, " \t\n ", "b"), (7, "ünïcödé 日本語 😀 it's", None)])
