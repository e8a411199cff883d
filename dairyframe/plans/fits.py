"""Curve fits over the test-day view.

All fits are of the measured yields and repeated in SQL (``fit_sql``); the tests compare them with brute force over their bounds and
with known parameters.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from dairyframe import datasets as ds
from dairyframe.functions import curves
from dairyframe.operators import characteristics as ch, fitting
from dairyframe.plans import fit_sql, query
from dairyframe.plans.models import SQL_FORMS

# Normal equations of (1, t/305, exp(-t/20)) solved by elimination, on lactations with >= 3 days.
WILMINK_SQL = """
    SELECT *, (r1 - m12 * b2 - m13 * c3) / m11 AS a, b2 / 305 AS b, c3 AS c, -0.05::DOUBLE AS k FROM (
      SELECT *, (q2 - p23 * c3) / p22 AS b2 FROM (
        SELECT *, (q3 - p23 / p22 * q2) / (p33 - p23 / p22 * p23) AS c3 FROM (
          SELECT *, m22 - m12 / m11 * m12 AS p22, m23 - m12 / m11 * m13 AS p23, m33 - m13 / m11 * m13 AS p33,
                 r2 - m12 / m11 * r1 AS q2, r3 - m13 / m11 * r1 AS q3 FROM (
            SELECT {key} count(DISTINCT dim) AS days, min(dim) AS first_dim, max(dim) AS last_dim, count(*) AS m11,
                   sum(dim / 305) AS m12, sum(exp(-0.05 * dim)) AS m13, sum(dim / 305 * dim / 305) AS m22,
                   sum(dim / 305 * exp(-0.05 * dim)) AS m23, sum(exp(-0.05 * dim) * exp(-0.05 * dim)) AS m33,
                   sum(milk_kg) AS r1, sum(dim / 305 * milk_kg) AS r2, sum(exp(-0.05 * dim) * milk_kg) AS r3
            FROM testday {group} HAVING count(DISTINCT dim) >= 3))))"""


@query(
    "fit_wilmink",
    ds.with_views(
        "testday",
        """SELECT test_id, days, round(a + b * first_dim + c * exp(-0.05 * first_dim), 3) AS first_fit,
                  round(a + b * last_dim + c * exp(-0.05 * last_dim), 3) AS last_fit,
                  round(sse + 0.0, 3) AS sse
           FROM f JOIN s USING (test_id)""",
        f=WILMINK_SQL.format(key="test_id,", group="GROUP BY test_id"),
        s="""SELECT test_id, sum(pow(milk_kg - (a + b * dim + c * exp(-0.05 * dim)), 2)) AS sse
             FROM testday JOIN f USING (test_id) GROUP BY 1""",
    ),
)
def wilmink(spark, sf_dir):
    """The fit seen through its values: ends of the curve inside the data and the residual sum.

    The parameters of nearly coincident days are ill-determined; what they predict is not.
    """
    records = ds.testday(spark, sf_dir)
    params = fitting.fit_curve(records, "wilmink").filter("reason is null")
    ends = records.groupBy("test_id").agg(F.min("dim").alias("first_dim"), F.max("dim").alias("last_dim"))
    sse = fitting.fit_residuals(records, params)
    joined = params.join(ends, "test_id").join(sse, "test_id")
    return joined.select(
        "test_id",
        "days",
        F.round(curves.curve("wilmink", F.col("first_dim")), 3).alias("first_fit"),
        F.round(curves.curve("wilmink", F.col("last_dim")), 3).alias("last_fit"),
        F.round(F.col("sse") + 0.0, 3).alias("sse"),
    )


def _measured(name: str):
    if name == "ali_schaeffer":
        sql = ds.with_views("testday", fit_sql.basis_fit(), **fit_sql.basis_relations())
    else:
        sql = ds.with_views("testday", fit_sql.ends(name), **fit_sql.bounded(name)).replace("WITH ", "WITH RECURSIVE ", 1)

    @query(f"fit_{name}", sql)
    def run(spark, sf_dir):
        """The fit of the measured yields, seen through its values: ends of the curve inside the data, residual sum, convergence."""
        days = fitting.nested_days(fitting.weighted_days(ds.testday(spark, sf_dir)))
        first = days.withColumn("first_dim", F.element_at("t", 1))
        fit = fitting.fit_nested(first, [name], keys=["test_id", "first_dim"])
        form = name.removesuffix("_trf")
        at = {"first_fit": F.col("first_dim"), "last_fit": F.col("max_dim").cast("double")}
        values = [F.round(curves.curve(form, day) + 0.0, fit_sql.digits(name)).alias(c) for c, day in at.items()]
        return fit.select("test_id", "days", "max_dim", "reason", "converged", *values, F.round(F.col("sse") + 0.0, 2).alias("sse"))


for _name in ("wood", "fischer", "milkbot", "milkbot_trf", "ali_schaeffer"):
    _measured(_name)


@query(
    "fit_population_curve",
    ds.with_views(
        "testday",
        """SELECT t.day, round(a + b * t.day + c * exp(-0.05 * t.day), 4) AS milk_kg
           FROM f, (SELECT unnest(range(1, greatest(305, (SELECT max(dim) FROM testday)) + 1)) AS day) t""",
        f=WILMINK_SQL.format(key="", group=""),
    ),
)
def population(spark, sf_dir):
    params = fitting.fit_population_curve(ds.testday(spark, sf_dir), "wilmink")
    return fitting.predict_curve(params).select("day", F.round("milk_kg", 4).alias("milk_kg"))


PARAMS_SQL = "SELECT test_id, 15.0 + test_id % 20 AS a, 0.2::DOUBLE AS b, 0.004::DOUBLE AS c FROM cow"


@query(
    "fit_residuals",
    ds.with_views(
        "testday cow",
        f"""SELECT test_id, count(*) AS n, round(sum(pow(milk_kg - ({SQL_FORMS["wood"]}), 2)), 3) AS sse
            FROM (SELECT test_id, milk_kg, CAST(dim AS DOUBLE) AS t, a, b, c FROM testday JOIN par USING (test_id)) GROUP BY 1""",
        par=PARAMS_SQL,
    ),
)
def residuals(spark, sf_dir):
    none = F.lit(None).cast("double")
    params = ds.cow(spark, sf_dir).select(
        "test_id",
        F.lit("wood").alias("model"),
        (15.0 + F.col("test_id") % 20).alias("a"),
        F.lit(0.2).alias("b"),
        F.lit(0.004).alias("c"),
        none.alias("d"),
        none.alias("k"),
    )
    out = fitting.fit_residuals(ds.testday(spark, sf_dir), params)
    return out.withColumn("sse", F.round("sse", 3))


@query(
    "residual_metrics",
    ds.with_views(
        "testday cow",
        f"""SELECT test_id, count(*) AS n, round(avg(abs(milk_kg - ({SQL_FORMS["wood"]}))), 4) AS mae,
                   round(sqrt(avg(pow(milk_kg - ({SQL_FORMS["wood"]}), 2))), 4) AS rmse
            FROM (SELECT test_id, avg(milk_kg) AS milk_kg, CAST(dim AS DOUBLE) AS t FROM testday WHERE dim <= 305 GROUP BY test_id, dim)
            JOIN par USING (test_id) GROUP BY 1""",
        par=PARAMS_SQL,
    ),
)
def metrics(spark, sf_dir):
    none = F.lit(None).cast("double")
    actual = (
        ds.testday(spark, sf_dir)
        .filter("dim <= 305")
        .groupBy("test_id", F.col("dim").alias("day"))
        .agg(F.avg("milk_kg").alias("milk_kg"))
    )
    params = ds.cow(spark, sf_dir).select(
        "test_id", F.lit("wood").alias("model"), (15.0 + F.col("test_id") % 20).alias("a"), F.lit(0.2).alias("b"),
        F.lit(0.004).alias("c"), none.alias("d"), none.alias("k"),
    )
    out = ch.residuals_at(params, actual, models=["wood"])
    return out.withColumns({c: F.round(c, 4) for c in ("mae", "rmse")})
