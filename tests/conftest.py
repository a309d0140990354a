import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from latticeloom.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_session("tests", cores="8", shuffle_partitions=4, memory="8g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
