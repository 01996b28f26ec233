from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))


@pytest.fixture(scope="session")
def spark():
    from clausespark.session import get_session

    session = get_session(
        "clausespark-tests",
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def scores_tiny(spark):
    """10 documents x 4 clauses: tied scores, an all-negative, an all-positive and an unmodelled clause."""
    rows = []
    for doc in range(10):
        rows.append((doc, "Insurance", [0.9, 0.8, 0.8, 0.8, 0.4, 0.4, 0.3, 0.2, 0.1, 0.1][doc], int(doc in (0, 2, 3, 6))))
        rows.append((doc, "Non-Compete", doc / 10, 0))
        rows.append((doc, "Change Of Control", 1 - doc / 20, 1))
        rows.append((doc, "Audit Rights", 0.0, int(doc == 5)))
    return spark.createDataFrame(rows, "doc_id long, clause string, prob double, y int").cache()
