import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents from (doc_id, text[, source]) rows, with extra columns of clashing names."""
    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", 7, "x", "y", 3) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, "
                                           "id string, fp string, n_words int")
    return make
