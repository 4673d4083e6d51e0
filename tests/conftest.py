import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def pytest_addoption(parser):
    parser.addoption("--all-queries", action="store_true", help="compare every registered query, not only the quick ones")
    parser.addoption("--sf", default="/root/testdata/sf0.001", help="folder with the tables")


@pytest.fixture(scope="session")
def spark():
    from oracle import session

    s = session()
    s.sparkContext.setLogLevel("ERROR")
    return s
