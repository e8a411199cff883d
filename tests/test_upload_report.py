"""The upload report's stages by lactation get tasks in proportion to the records, and give the rows of its SQL."""

import random
import re

import duckdb
import pytest

from dairyframe import datasets as ds, plans

plans.load_all()


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def write_tables(top, lactations):
    """Records of some lactations more than others, days that repeat, keys that are null, without a partner or there twice."""
    rnd = random.Random(lactations)
    con = duckdb.connect()
    lines = [(i % lactations if i % 40 else None, rnd.randrange(400), rnd.randrange(1500), 1 + rnd.randrange(7), float(rnd.randrange(1, 50))) for i in range(3 * lactations)]
    lines += [(5, rnd.randrange(400), 7, 1, 20.0) for _ in range(lactations)]
    orders = [(i, i % 30) for i in range(lactations) if i % 11] + [(3, 3), (4, 4), (4, 4), (None, 1), (lactations + 9, None)]
    for name, columns, rows in (
        ("lineitem", "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INTEGER, l_quantity DOUBLE", lines),
        ("orders", "o_orderkey BIGINT, o_custkey BIGINT", orders),
        ("customer", "c_custkey BIGINT, c_nationkey INTEGER", [(i, i % 5) for i in range(28)]),
    ):
        con.execute(f"CREATE TABLE {name} ({columns})")
        con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
        con.execute(f"COPY {name} TO '{top}/{name}.parquet' (FORMAT parquet)")
    return con


@pytest.mark.parametrize("lactations", [100, 200])
def test_tasks_grow_with_the_records(spark, tmp_path, monkeypatch, no_broadcast, lactations):
    con = write_tables(tmp_path, lactations)
    monkeypatch.setattr(ds, "TASK_RECORDS", 10, raising=False)
    out = plans.QUERIES["upload_report"](spark, str(tmp_path))
    parts = re.findall(r"hashpartitioning\(test_id#\d+L?, (\d+)\)", out._jdf.queryExecution().executedPlan().toString())
    assert parts and {int(n) for n in parts} == {4 * lactations // 10}
    cursor = con.execute(plans.ORACLE["upload_report"])
    want = dict(zip([c[0] for c in cursor.description], cursor.fetchone(), strict=True))
    got = out.first().asDict()
    assert got == pytest.approx(want, abs=1e-4) and got["usable"] > lactations
    assert got["row_count"] < 4 * lactations  # null keys and lactations without an order are no records
    monkeypatch.setattr(ds, "TASK_RECORDS", 10**9, raising=False)
    assert plans.QUERIES["upload_report"](spark, str(tmp_path)).first().asDict() == pytest.approx(got, abs=1e-4)
