import pytest


@pytest.fixture
def docs(spark):
    """Makes a documents table with an extra column whose name an operator uses inside."""

    def make(rows):
        full = [(i, t, lang, source, None if t is None else len(t), "x", 7) for i, t, lang, source in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, size string, fp int")

    return make
