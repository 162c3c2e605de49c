import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SMALL_SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from medlattice.session import build_session
    s = build_session(master="local[4]", shuffle_partitions=4, app_name="medlattice-tests")
    yield s


@pytest.fixture
def tmpdir_path(tmp_path):
    return str(tmp_path)
