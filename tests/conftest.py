import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__  # noqa: E402, F401  (ships the package with the jobs)
from dairyframe.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "6g", "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def testdays(spark):
    """Frame of (test_id, dim, milk_kg) records with pos in the order given."""

    def make(records):
        rows = [(i, d, None if m is None else float(m), p) for p, (i, d, m) in enumerate(records)]
        return spark.createDataFrame(rows, "test_id bigint, dim int, milk_kg double, pos bigint")

    return make


def by_id(df, value, key="test_id"):
    return {row[key]: row[value] for row in df.collect()}
