from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from vendaflux.plans.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", shuffle_partitions=8, app="tests",
                            extra={"spark.ui.enabled": "false", "spark.driver.memory": "6g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def rows(df):
    """Rows as tuples, in any order."""
    return sorted((tuple(r) for r in df.collect()), key=str)


def by_key(df, key):
    return {r[key]: r.asDict() for r in df.collect()}
