import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from salesframe.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", 4, "salesframe-tests", {
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_monthly(spark):
    """Raw rows of a panel from {key: [monthly values]}."""
    def make(series, start="2022-01"):
        year, month = map(int, start.split("-"))
        rows = []
        for key, values in series.items():
            for i, v in enumerate(values):
                y, m = divmod(year * 12 + month - 1 + i, 12)
                rows.append((key, f"{y:04d}-{m + 1:02d}-01", float(v)))
        return spark.createDataFrame(rows, "k string, d string, Sales double").selectExpr(
            "k", "CAST(d AS DATE) AS Date", "Sales")
    return make
