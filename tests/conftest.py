import os
import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"  # for Spark's Python workers


@pytest.fixture(scope="session")
def spark():
    from ledgerloom.session import SETTINGS
    from pyspark.sql import SparkSession

    settings = SETTINGS | {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false"}
    s = SparkSession.builder.master("local[4]").appName("tests").config(map=settings).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
