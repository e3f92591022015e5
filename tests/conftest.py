import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from casepipe.session import local_session

    s = local_session(cores=8, shuffle_partitions=8, app="casepipe-tests")
    yield s
    s.stop()


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="casepipe-test-", dir="/tmp")
