import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from arbora.runtime import session

    return session("4", "tests", **{"spark.driver.memory": "3g", "spark.sql.shuffle.partitions": "4"})


@pytest.fixture(scope="session")
def data():
    directory = "/root/testdata/sf0.001"
    if not os.path.isdir(directory):
        pytest.skip("no test tables here")
    return directory
