import os
import sys

import pytest

os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--conf spark.ui.enabled=false --conf spark.ui.showConsoleProgress=false --driver-memory 8g pyspark-shell")
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from segue.session import build_session

    s = build_session("local[8]", 8, "segue-tests")
    s.sparkContext.setLogLevel("ERROR")
    return s
