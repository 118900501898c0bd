import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from moundflow.session import local_session
    s = local_session(cores="*", shuffle_partitions=8, app="moundflow-tests")
    yield s


@pytest.fixture(scope="session")
def small_dir():
    return SMALL
