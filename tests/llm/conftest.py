from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from conftest_llm import CLASHES, SCHEMA, odd_rows  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and very long texts, ties, repeated rows and columns of clashing names."""
    rows = [(*r, 1, "k", "a", "w", "h", 5, 0.5, 6, "v", "b", 7) for r in odd_rows()]
    return spark.createDataFrame(rows, f"{SCHEMA}, {CLASHES}").repartition(3)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], f"{SCHEMA}, {CLASHES}")
