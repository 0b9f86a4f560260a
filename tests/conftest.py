from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from trackloom.session import session

    s = session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g", "spark.sql.ansi.enabled": "true"})
    s.sparkContext.setLogLevel("ERROR")
    yield s


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF
