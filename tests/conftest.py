import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from estate.testing import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session()
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """Rows under a DDL schema."""
    return lambda rows, ddl: spark.createDataFrame(rows, ddl)


@pytest.fixture
def rows():
    """Rows of a frame as sorted tuples of the given columns."""

    def collect(df, *columns):
        out = [tuple(r[c] for c in columns or df.columns) for r in df.collect()]
        return sorted(out, key=lambda t: [(v is None, str(v)) for v in t])

    return collect
