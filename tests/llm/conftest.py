import pytest


@pytest.fixture
def docs_of(spark):
    """A documents table, with extra columns named as the operators' own, from
    (doc_id, text[, source]) rows."""
    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None, "x", 1, "y", 2, None) for r in rows]
        return spark.createDataFrame(
            full, "doc_id long, text string, lang string, source string, n_chars long, words string, "
                  "text_hash long, host string, `a.b` int, line string")
    return make
