import pytest
from hypothesis import settings
from pyspark.sql import SparkSession

settings.register_profile("repeatable", derandomize=True, deadline=None, database=None)
settings.load_profile("repeatable")


def make_session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .appName("textvariety-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@pytest.fixture(scope="session")
def spark():
    session = make_session()
    yield session
    session.stop()
