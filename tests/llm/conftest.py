import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    """Documents of (doc_id, text) pairs, with the columns of the table and, if asked, extra ones with awkward names."""

    def make(pairs, extra=()):
        rows = [(i, t, "en", "s", len(t or ""), *("x" for _ in extra)) for i, t in pairs]
        return spark.createDataFrame(rows, SCHEMA + "".join(f", {c} string" for c in extra))

    return make


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"
