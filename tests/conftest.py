import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (str(ROOT), os.environ.get("PYTHONPATH", "")) if x)

from rasterloom.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    config = {"spark.master": "local[8]", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g"}
    out = session("tests", **config)
    out.sparkContext.setLogLevel("ERROR")
    return out
