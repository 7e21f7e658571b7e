import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from latticeflow.session import local_session

    session = local_session("tests", cpus=4, partitions=4)
    yield session
    session.stop()


SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def sf_dir():
    return SF
