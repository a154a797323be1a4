import sys
from pathlib import Path

import pytest

TOP = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(TOP), str(TOP / "tests")]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from millrace.session import session
    from millrace.shipping import ship

    s = session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s
    s.stop()
