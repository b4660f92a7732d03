import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from wastelens.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("compartido")),
        "spark.ui.showConsoleProgress": "false", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def day():
    return lambda i, start=dt.date(2026, 1, 1): start + dt.timedelta(days=i)


@pytest.fixture(scope="session")
def make_series(spark, day):
    """A series frame from {name: values}, one value per day."""
    def build(**series):
        rows = [(name, day(i), float(v)) for name, values in series.items() for i, v in enumerate(values)]
        return spark.createDataFrame(rows, "serie string, fecha date, cantidad double")

    return build
