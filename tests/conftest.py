import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT


@pytest.fixture(scope="session")
def spark():
    from lexmill.session import get_spark, ship_code

    s = get_spark(master="local[4]", partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    ship_code(s)
    yield s
    s.stop()
