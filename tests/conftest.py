import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from answerlake.session import Tables, get_session  # noqa: E402
from answerlake.streaming.streams import STATE_STORE  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = get_session("local[4]", 4)
    session.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return session


@pytest.fixture(scope="session")
def tables(spark):
    return Tables(spark, SMALL)


@pytest.fixture
def rows():
    """Rows of a frame as a sorted list of tuples."""
    def collect(df, *columns):
        return sorted((tuple(r[c] for c in (columns or df.columns)) for r in df.collect()), key=str)
    return collect
