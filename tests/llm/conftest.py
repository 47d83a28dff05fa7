import pytest

from vicinage.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(memory="8g")


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text[, lang, source]) with columns whose names clash with inner ones."""
    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", "x", 1, 2) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, id string, _d int, key int")
    return make
