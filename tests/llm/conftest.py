import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) rows, with other columns whose names the operators use inside."""

    def make(rows):
        extra = "h long, n long, rep string, c string, component string, bands string, lines string, cuts string, score string, words string"
        return spark.createDataFrame([(i, t, "en", "src", *[None] * 10) for i, t in rows], "doc_id long, text string, lang string, source string, " + extra)

    return make
