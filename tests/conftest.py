"""One local session for all tests."""

import os
import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ["PYTHONPATH"] = os.pathsep.join([str(Path(__file__).resolve().parent.parent), os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    with tempfile.TemporaryDirectory() as folder:
        conf = {
            "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC",
            "spark.driver.memory": "4g", "spark.checkpoint.dir": f"file://{folder}/checkpoints", "spark.sql.warehouse.dir": f"file://{folder}/warehouse",
        }
        session = SparkSession.builder.master("local[8]").config(map=conf).getOrCreate()
        session.sparkContext.setLogLevel("ERROR")
        yield session
        session.stop()


@pytest.fixture(scope="session")
def sf():
    """The smallest driver tables."""
    folder = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
    if not folder.exists():
        pytest.skip(f"no tables in {folder}")
    return str(folder)
