from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from roundforge.session import SETTINGS

    at = tmp_path_factory.mktemp("spark")
    conf = SETTINGS | {"spark.master": "local[8]", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g", "spark.checkpoint.dir": f"file://{at}/shared", "spark.sql.warehouse.dir": f"{at}/warehouse", "spark.executorEnv.PYTHONPATH": str(ROOT)}
    session = SparkSession.builder.config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(f"file://{at}/shared")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    at = DATA / "sf0.001"
    if not at.exists():
        pytest.skip("no test tables here")
    return str(at)
