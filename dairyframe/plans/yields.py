"""Yield rules over the test-day view."""

from __future__ import annotations

from pyspark.sql import functions as F

from dairyframe import datasets as ds
from dairyframe.operators import yields
from dairyframe.plans import query

TEST_INTERVAL_SQL = """
    SELECT test_id,
           max(CASE WHEN rn = 1 THEN dim * milk_kg END)
           + coalesce(sum((nd - dim) * (milk_kg + nm) / 2), 0)
           + max(CASE WHEN rn = n THEN (306 - dim) * milk_kg END) AS yield_kg
    FROM (SELECT test_id, dim, milk_kg, lead(dim) OVER w AS nd, lead(milk_kg) OVER w AS nm,
                 row_number() OVER w AS rn, count(*) OVER (PARTITION BY test_id) AS n
          FROM testday WHERE dim <= 305 WINDOW w AS (PARTITION BY test_id ORDER BY dim, pos))
    WHERE n >= 2 GROUP BY test_id"""

# Per lactation: observed and capped trapezoids, near-day means, mean day.
PROFILE_SQL = """
    SELECT test_id, count(*) AS n, avg(dim) AS mean_dim,
      CASE WHEN count(CASE WHEN dim > 0 THEN 1 END) >= 2 THEN sum((pm + milk_kg) / 2 * (dim - pd)) END AS observed,
      CASE WHEN count(CASE WHEN dim > 0 THEN 1 END) >= 2 THEN
        sum(CASE WHEN dim <= 305 THEN (pm + milk_kg) / 2 * (dim - pd)
                 WHEN pd < 305 THEN (pm + pm + (305.0 - pd) / (dim - pd) * (milk_kg - pm)) / 2 * (305 - pd)
                 ELSE 0 END)
        + max(CASE WHEN rn = 1 AND dim < 305 THEN milk_kg * (305 - dim) ELSE 0 END) END AS capped,
      coalesce(avg(CASE WHEN abs(dim - 21) <= 7 THEN milk_kg END),
               CASE WHEN min(abs(dim - 21)) <= 21 THEN arg_min(milk_kg, abs(dim - 21) * 1000000 + dim * 1000 + milk_kg) END) AS near_21,
      coalesce(avg(CASE WHEN abs(dim - 75) <= 10 THEN milk_kg END),
               CASE WHEN min(abs(dim - 75)) <= 30 THEN arg_min(milk_kg, abs(dim - 75) * 1000000 + dim * 1000 + milk_kg) END) AS near_75
    FROM (SELECT test_id, dim, milk_kg, lag(dim, 1, 0) OVER w AS pd, lag(milk_kg, 1, 0.0) OVER w AS pm,
                 row_number() OVER (PARTITION BY test_id ORDER BY dim DESC, milk_kg DESC, pos) AS rn
          FROM testday WINDOW w AS (PARTITION BY test_id ORDER BY dim, milk_kg, pos))
    GROUP BY test_id"""


@query(
    "test_interval_yield",
    ds.with_views("testday", "SELECT test_id, round(yield_kg, 4) AS yield_kg FROM r", r=TEST_INTERVAL_SQL),
)
def test_interval(spark, sf_dir):
    out = yields.test_interval_yield(ds.testday(spark, sf_dir))
    return out.select("test_id", F.round("yield_kg", 4).alias("yield_kg"))


test_interval.__test__ = False


@query(
    "trapezoid_observed",
    ds.with_views("testday", "SELECT test_id, round(observed, 4) AS yield_kg FROM p", p=PROFILE_SQL),
)
def observed(spark, sf_dir):
    out = yields.trapezoid_observed(ds.testday(spark, sf_dir))
    return out.select("test_id", F.round("yield_kg", 4).alias("yield_kg"))


@query(
    "trapezoid_capped",
    ds.with_views("testday", "SELECT test_id, round(capped, 4) AS yield_kg FROM p", p=PROFILE_SQL),
)
def capped(spark, sf_dir):
    out = yields.trapezoid_capped(ds.testday(spark, sf_dir))
    return out.select("test_id", F.round("yield_kg", 4).alias("yield_kg"))


@query(
    "first_last_record",
    ds.with_views(
        "testday",
        """SELECT test_id, min(dim) AS first_dim, max(CASE WHEN up = 1 THEN milk_kg END) AS first_milk,
                  max(dim) AS last_dim, max(CASE WHEN down = 1 THEN milk_kg END) AS last_milk
           FROM (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY dim, pos) AS up,
                        row_number() OVER (PARTITION BY test_id ORDER BY dim DESC, pos DESC) AS down FROM testday)
           GROUP BY test_id""",
    ),
)
def first_last(spark, sf_dir):
    return yields.first_last_record(ds.testday(spark, sf_dir))


@query(
    "argmax_day",
    ds.with_views(
        "testday",
        """SELECT test_id, min(dim) AS peak_day, max(milk_kg) AS peak_kg
           FROM (SELECT *, max(milk_kg) OVER (PARTITION BY test_id) AS top FROM testday)
           WHERE milk_kg = top GROUP BY test_id""",
    ),
)
def argmax(spark, sf_dir):
    return yields.argmax_day(ds.testday(spark, sf_dir))
