import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from rillwork import session

    s = session.build("local[4]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("OFF")
    yield s


@pytest.fixture
def text_path(tmp_path):
    def write(data: bytes) -> str:
        p = tmp_path / f"input{len(list(tmp_path.iterdir()))}.txt"
        p.write_bytes(data)
        return str(p)

    return write
