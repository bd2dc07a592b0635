import os
import sys

import pytest
from hypothesis import settings

settings.register_profile("here", deadline=None, max_examples=50)
settings.load_profile("here")

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from blockloom.session import local_session

    session = local_session(4, memory="3g", shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    return DATA
