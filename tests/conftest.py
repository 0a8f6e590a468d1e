import os
import sys
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

import pytest  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def moved(spark):
    """A function that runs an action without broadcasts chosen by size and tells how many records its stages shuffled."""

    def run(action):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.sparkContext.setJobGroup("moved", "moved")
        try:
            jvm, store = spark.sparkContext._jvm, spark.sparkContext._jsc.sc().statusStore()
            stages = lambda: store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
            total = lambda: sum(x.apply(i).shuffleWriteRecords() for x in [stages()] for i in range(x.size()))
            before = total()
            action()
            return total() - before
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

    return run
