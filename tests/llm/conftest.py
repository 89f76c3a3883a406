import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """A documents table from (doc_id, text[, lang, source]) rows."""
    def make(rows, schema=DOCS):
        full = [(*r, *(None,) * (4 - len(r)), len(r[1]) if r[1] else 0) for r in rows]
        return spark.createDataFrame(full, schema)
    return make
