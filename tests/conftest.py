import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tracewell.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8, 4)


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SMALL):
        pytest.skip("test tables are absent")
    return SMALL
