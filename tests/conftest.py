import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tarmac.session import build_session
    s = build_session("local[4]", app="tarmac-tests", shuffle_partitions=4, driver_memory="4g")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF_SMALL
