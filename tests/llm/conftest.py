import pytest

from wattlens.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[*]", shuffle_partitions=8, app_name="wattlens-llm-tests")
    yield s


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Builds a documents table from (doc_id, text) pairs, with an extra column and clashing names."""
    def make(rows, extra=True):
        df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)
        return df
    return make


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}
