from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from hillspan.session import session

    s = session("tests", cores=4, shuffle_partitions=4, spark_driver_memory="4g", spark_sql_ansi_enabled="true")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
