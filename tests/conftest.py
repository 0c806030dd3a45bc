import shutil

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    made = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    made.sparkContext.setLogLevel("ERROR")
    folder = tmp_path_factory.mktemp("checkpoints")
    if made.sparkContext.getCheckpointDir() is None:
        made.sparkContext.setCheckpointDir(str(folder))
    yield made
    made.stop()
    shutil.rmtree(folder, ignore_errors=True)
