"""One local session for all tests."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from graphspark.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_spark("tests", cpus=4, **{"spark.driver.memory": "4g"})
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()
