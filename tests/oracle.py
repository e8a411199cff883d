"""Run registered queries next to their SQL and compare the rows, order-blind."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_cell(x) for x in v) + "]"
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return repr(float(v) + 0.0)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir):
    """(ok, message) for one query."""
    df = fn(spark, sf_dir)
    left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    right = rows_of([d[0] for d in cur.description], cur.fetchall())
    if left[0] != right[0]:
        return False, f"columns {left[0]} != {right[0]}"
    if len(left[1]) != len(right[1]):
        return False, f"rows {len(left[1])} != {len(right[1])}"
    bad = [(a, b) for a, b in zip(left[1], right[1]) if a != b]
    if bad:
        return False, f"{len(bad)} of {len(left[1])} rows differ, first {bad[0]}"
    if not left[1]:
        return False, "no rows"
    return True, f"{len(left[1])} rows"


def main(argv):
    sys.path.insert(0, "/root/repo")
    from dairyframe import plans
    from dairyframe.session import local_session

    sf_dir = "/root/testdata/sf0.01"
    import importlib

    if argv:
        for module in argv[0].split(","):
            importlib.import_module(f"dairyframe.plans.{module}")
    else:
        plans.load_all()
    only = set(argv[1].split(",")) if len(argv) > 1 else None
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name, fn in plans.QUERIES.items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            if name in plans.ORACLE:
                ok, message = compare(spark, con, name, fn, plans.ORACLE[name], sf_dir)
            else:
                df = fn(spark, sf_dir)
                n = len(df.collect())
                ok, message = n > 0, f"{n} rows, no oracle"
        except Exception as error:  # noqa: BLE001
            ok, message = False, f"{type(error).__name__}: {str(error)[:600]}"
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} {time.time() - start:6.2f}s {message}", flush=True)
    print("failed:", failed)
    spark.stop()
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
