import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark():
    from finstrata.session import local_session

    return local_session(cpus=min(8, os.cpu_count() or 2), shuffle_partitions=4, memory="4g")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
