"""Every registered query next to its SQL on the smallest tables."""

import oracle
import pytest

from dairyframe import plans

plans.load_all()
SF = "/root/testdata/sf0.001"
#: Queries whose filters leave nothing of the smallest tables; both sides have to agree on that.
MAY_BE_EMPTY: set[str] = set()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_matches_sql(spark, con, name):
    ok, message = oracle.compare(spark, con, name, plans.QUERIES[name], plans.ORACLE[name], SF)
    assert ok or (message == "no rows" and name in MAY_BE_EMPTY), message


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE)))
def test_runs_without_sql(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0
