import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.dirname(os.path.abspath(__file__))]


@pytest.fixture(scope="session")
def spark():
    from tidewell.session import local_session

    return local_session(8, "tidewell-tests")


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"
