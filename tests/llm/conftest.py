import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, of int"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table with extra columns whose names operators use within; rows are (doc_id, text[, source])."""

    def make(rows, parts=3):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "x", 1) for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(parts)

    return make
