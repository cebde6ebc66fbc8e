import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (id, text) pairs, with a column whose name clashes with the operators' own."""

    def build(rows):
        data = [(i, t, "x", "y", None if t is None else len(t), "mine") for i, t in rows]
        return spark.createDataFrame(
            data, "doc_id long, text string, lang string, source string, n_chars long, key string"
        )

    return build
