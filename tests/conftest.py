import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from panelfx.operators.panel import PanelSpec  # noqa: E402
from panelfx.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "panelfx-tests",
        master="local[4]",
        conf={
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SPEC = PanelSpec(unit="u", time="t", cohort="g", target="y")
# cohort and outcomes at t = 1, 2, 3
GOLDEN = {
    1: (2, [1, 3, 4]),
    2: (2, [2, 5, 5]),
    3: (3, [1, 1, 4]),
    4: (3, [3, 4, 8]),
    5: (None, [2, 3, 3]),
    6: (None, [4, 4, 5]),
}


def panel_rows(units=GOLDEN):
    return [(u, t + 1, g, float(y)) for u, (g, ys) in units.items() for t, y in enumerate(ys)]


@pytest.fixture(scope="session")
def golden(spark):
    return spark.createDataFrame(panel_rows(), "u bigint, t int, g bigint, y double")


@pytest.fixture(scope="session")
def random_panel():
    """60 units in cohorts 3, 5, 8 and never treated, 9 times, unit and time effects."""
    import numpy as np

    rng = np.random.default_rng(7)
    units = {}
    for u in range(60):
        g = [3, 5, 8, None][u % 4]
        ys = rng.normal(size=9) + 10 * rng.normal() + np.arange(9)
        if g is not None:
            ys[g - 1 :] += 2.0
        units[u] = (g, [float(y) for y in ys])
    return units
