import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

@pytest.fixture(scope="session")
def sf0001():
    """Folder of the smallest test tables."""
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from parasift.session import local_session, ship_package

    s = local_session(cores=4, shuffle_partitions=8)
    ship_package(s)
    yield s
    s.stop()
