import pytest

from tests.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(name="ledgerlens-tests")


@pytest.fixture
def documents(spark):
    """``documents([(doc_id, text), ...])`` with the columns of that table."""

    def build(rows, source="s"):
        full = [(i, t, "en", source, None if t is None else len(t)) for i, t in rows]
        schema = "doc_id long, text string, lang string, source string, n_chars long"
        return spark.createDataFrame(full, schema)

    return build
