import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from granary.session import session

    top = tmp_path_factory.mktemp("spark")
    s = session("tests", master="local[4]", shuffle_partitions=4, **{"spark.sql.warehouse.dir": str(top / "warehouse"), "spark.checkpoint.dir": str(top / "shared"), "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
