import pathlib
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def run(spark):
    """Value of one column expression for each of some one-column rows."""

    def values(expression, inputs, ddl="x STRING"):
        rows = [(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(inputs)]
        frame = spark.createDataFrame(rows, f"i INT, {ddl}")
        return [r["v"] for r in frame.select("i", expression.alias("v")).orderBy("i").collect()]

    return values
