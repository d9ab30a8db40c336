import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = os.environ.get("QUARRY_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from quarry.session import get_session
    s = get_session("local[*]", 8, app="quarry-tests")
    yield s


@pytest.fixture(scope="session")
def sf_dir():
    return SF_SMALL
