import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF_SMALL = os.environ.get("SCOREWISE_TEST_SF", "/root/testdata/sf0.001")
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from scorewise.session import local_session
    s = local_session(cores="*", shuffle_partitions=8, app="scorewise-tests")
    yield s


@pytest.fixture(scope="session")
def sf():
    return SF_SMALL


@pytest.fixture(scope="session")
def duck():
    from tests.oracle_util import duck_connection
    return duck_connection(SF_SMALL)
