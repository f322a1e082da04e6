import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from usagelens.session import get_session

    s = get_session(master="local[4]", partitions=4)
    yield s


@pytest.fixture(scope="session")
def tables(spark):
    from usagelens.sources import fixtures

    return fixtures.load_tables(spark, SF_SMALL)
