"""Grid interpolation, standard-curve yields and best prediction over the test-day view."""

from __future__ import annotations

from pyspark.sql import functions as F

from dairyframe import datasets as ds
from dairyframe.functions import daily
from dairyframe.operators import alignment as al, best_prediction as bp, standard_curve as sc
from dairyframe.plans import query

# A neutral standard: a straight curve from 40 to 20 kg, correlation fading with distance, rising std.
CURVE = [40 - 20.0 * day / 305 for day in range(306)]


def _standard(grid) -> sc.Standard:
    correlation = [[0.995 ** abs(i - p) for p in grid] for i in grid]
    return sc.Standard(CURVE, correlation, [5 + g / 100 for g in grid], grid)


def g_sql(day: str) -> str:
    return f"(40 - (20.0::DOUBLE * {day}) / 305)"


def b_sql(i: str, p: str) -> str:
    return f"(pow(0.995::DOUBLE, abs({i} - {p})) * (5 + {p} / 100) / (5 + {i} / 100))"


def _grid_sql(grid) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"({g})" for g in grid) + ") AS v(g)"


def grid_views(grid) -> dict[str, str]:
    return dict(
        days="""SELECT test_id, dim, arg_min(milk_kg, pos) AS first, arg_max(milk_kg, pos) AS last
                FROM testday WHERE dim <= 305 GROUP BY 1, 2""",
        grid=_grid_sql(grid),
        br="""SELECT test_id, g, max(CASE WHEN dim < g THEN dim END) AS bd, min(CASE WHEN dim > g THEN dim END) AS ad,
                     max(CASE WHEN dim = g THEN first END) AS exact FROM days CROSS JOIN grid GROUP BY 1, 2""",
        br2="""SELECT br.*, b.first AS bm, a.first AS am FROM br LEFT JOIN days b ON b.test_id = br.test_id AND b.dim = bd
                LEFT JOIN days a ON a.test_id = br.test_id AND a.dim = ad""",
        pts=f"""SELECT * FROM (SELECT test_id, g, CASE WHEN exact IS NOT NULL THEN exact
                   WHEN bd IS NOT NULL AND ad IS NOT NULL AND ad < 305 THEN {g_sql("g")}
                     + ((am - bm) - ({g_sql("ad")} - {g_sql("bd")})) / (ad - bd) * (g - bd) + (bm - {g_sql("bd")}) END AS y
                 FROM br2) WHERE y IS NOT NULL""",
        lin="""SELECT * FROM (SELECT test_id, g, CASE WHEN exact IS NOT NULL THEN exact
                   WHEN bd IS NOT NULL AND ad IS NOT NULL THEN bm + (am - bm) / (ad - bd) * (g - bd) END AS y
                 FROM br2) WHERE y IS NOT NULL""",
    )


WIDE = grid_views(sc.WIDE_GRID)
INNER = grid_views(sc.GRID_DAYS)


@query(
    "join_bracket",
    ds.with_views(
        "testday",
        """SELECT test_id, g AS grid_day, bd AS before_day, bm AS before_milk, ad AS after_day, am AS after_milk FROM br2""",
        **INNER,
    ),
)
def bracket(spark, sf_dir):
    return sc.bracket_days(ds.testday(spark, sf_dir), grid=sc.GRID_DAYS)


@query(
    "interp_standard_curve",
    ds.with_views("testday", "SELECT test_id, g AS grid_day, round(y, 9) AS milk_kg FROM pts", **WIDE),
)
def interp_standard(spark, sf_dir):
    out = sc.interp_standard_curve(ds.testday(spark, sf_dir), CURVE)
    return out.withColumn("milk_kg", F.round("milk_kg", 9))


@query(
    "interp_linear_range",
    ds.with_views("testday", "SELECT test_id, g AS grid_day, round(y, 9) AS milk_kg FROM lin", **WIDE),
)
def interp_range(spark, sf_dir):
    out = sc.interp_linear_range(ds.testday(spark, sf_dir))
    return out.withColumn("milk_kg", F.round("milk_kg", 9))


@query(
    "interp_linear_all",
    ds.with_views(
        "testday",
        """SELECT g.test_id, g AS grid_day, round(coalesce(lin.y,
                CASE WHEN g < d1 THEN m1 + (m2 - m1) / (d2 - d1) * (g - d1) ELSE m3 + (m4 - m3) / (d4 - d3) * (g - d3) END), 9) AS milk_kg
           FROM (SELECT * FROM ends CROSS JOIN grid) g LEFT JOIN lin USING (test_id, g)""",
        **WIDE,
        num="""SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY dim) AS up,
                      row_number() OVER (PARTITION BY test_id ORDER BY dim DESC) AS down FROM days""",
        ends="""SELECT test_id, max(CASE WHEN up = 1 THEN dim END) AS d1, max(CASE WHEN up = 1 THEN first END) AS m1,
                       max(CASE WHEN up = 2 THEN dim END) AS d2, max(CASE WHEN up = 2 THEN first END) AS m2,
                       max(CASE WHEN down = 2 THEN dim END) AS d3, max(CASE WHEN down = 2 THEN first END) AS m3,
                       max(CASE WHEN down = 1 THEN dim END) AS d4, max(CASE WHEN down = 1 THEN first END) AS m4
                FROM num GROUP BY 1 HAVING count(*) >= 2""",
    ),
)
def interp_all(spark, sf_dir):
    out = sc.interp_linear_all(ds.testday(spark, sf_dir))
    return out.withColumn("milk_kg", F.round("milk_kg", 9))


@query(
    "join_outer_coalesce",
    ds.with_views(
        "testday",
        """SELECT coalesce(d.test_id, l.test_id) AS test_id, coalesce(d.dim, l.g) AS dim,
                  round(coalesce(d.last, l.y), 9) AS milk_kg, d.dim IS NOT NULL AS measured
           FROM days d FULL JOIN lin l ON d.test_id = l.test_id AND d.dim = l.g""",
        **WIDE,
    ),
)
def outer_coalesce(spark, sf_dir):
    records = ds.testday(spark, sf_dir).filter("dim <= 305")
    out = sc.measured_or_interpolated(al.dedup_day(records, keep="last"), sc.interp_linear_range(records))
    return out.withColumn("milk_kg", F.round("milk_kg", 9))


NEAREST = """
    SELECT m.test_id, m.g, arg_min(p.g, abs(p.g - m.g) * 1000 + p.g) AS i
    FROM (SELECT ids.test_id, grid.g FROM (SELECT DISTINCT test_id FROM pts) ids CROSS JOIN grid
          WHERE (ids.test_id, grid.g) NOT IN (SELECT (test_id, g) FROM {known})) m
    JOIN pts p ON p.test_id = m.test_id GROUP BY 1, 2"""


@query(
    "join_nearest",
    ds.with_views(
        "testday",
        "SELECT test_id, g AS grid_day, i AS nearest_day FROM near",
        **WIDE,
        near=NEAREST.format(known="pts"),
    ),
)
def nearest(spark, sf_dir):
    return sc.nearest_grid_days(ds.testday(spark, sf_dir), CURVE)


@query(
    "islc_yield",
    ds.with_views(
        "testday",
        """SELECT test_id, round(yield_kg, 3) AS yield_kg FROM (SELECT DISTINCT test_id FROM days) LEFT JOIN
             (SELECT test_id, sum((nd - day) * (y + ny) / 2) AS yield_kg
              FROM (SELECT test_id, day, y, lead(day) OVER w AS nd, lead(y) OVER w AS ny FROM line
                    WINDOW w AS (PARTITION BY test_id ORDER BY day)) WHERE test_id IN (SELECT test_id FROM pts) GROUP BY 1)
           USING (test_id)""",
        **WIDE,
        known="""SELECT test_id, dim AS g, last AS y FROM days UNION ALL
                 SELECT test_id, g, y FROM pts ANTI JOIN days ON days.test_id = pts.test_id AND days.dim = pts.g""",
        near=NEAREST.format(known="known"),
        line=f"""SELECT test_id, g AS day, y FROM known UNION ALL
                 SELECT near.test_id, near.g, {g_sql("near.g")} + {b_sql("near.i", "near.g")} * (p.y - {g_sql("near.i")})
                 FROM near JOIN pts p ON p.test_id = near.test_id AND p.g = near.i""",
    ),
)
def islc(spark, sf_dir):
    out = sc.islc_yield(ds.testday(spark, sf_dir), _standard(sc.WIDE_GRID))
    return out.withColumn("yield_kg", F.round("yield_kg", 3))


@query(
    "islc_original_yield",
    ds.with_views(
        "testday",
        f"""SELECT test_id, round(k.kg + coalesce(m.kg, 0) + coalesce(m.b, 0) * (lastp.y - {g_sql("lastp.g")}), 3) AS yield_kg
            FROM (SELECT DISTINCT test_id FROM days) LEFT JOIN k USING (test_id) LEFT JOIN m USING (test_id) LEFT JOIN lastp USING (test_id)""",
        **INNER,
        near=NEAREST.format(known="pts"),
        lastp="SELECT test_id, max(g) AS g, arg_max(y, g) AS y FROM pts GROUP BY 1",
        k="SELECT test_id, sum(y * CASE WHEN g = 290 THEN 25 ELSE 20 END) AS kg FROM pts GROUP BY 1",
        m=f"""SELECT near.test_id, sum({g_sql("near.g")} * CASE WHEN near.g = 290 THEN 25 ELSE 20 END) AS kg,
                     sum(CASE WHEN lastp.g = 290 AND near.g = top.g THEN 0
                              ELSE {b_sql("near.i", "near.g")} * CASE WHEN near.g = 290 THEN 25 ELSE 20 END END) AS b
              FROM near JOIN lastp USING (test_id) JOIN (SELECT test_id, max(g) AS g FROM near GROUP BY 1) top USING (test_id)
              GROUP BY 1""",
    ),
)
def islc_original(spark, sf_dir):
    out = sc.islc_original_yield(ds.testday(spark, sf_dir), _standard(sc.GRID_DAYS))
    return out.withColumn("yield_kg", F.round("yield_kg", 3))


SCALED = dict(
    z="""SELECT test_id, g, (y - avg(y) OVER w) / stddev_samp(y) OVER w AS z FROM
         (SELECT * FROM pts WHERE test_id IN (SELECT test_id FROM pts GROUP BY 1 HAVING stddev_samp(y) > 1e-9))
         WINDOW w AS (PARTITION BY test_id)"""
)


@query(
    "standard_representation",
    ds.with_views(
        "testday",
        """SELECT a.g AS day_i, b.g AS day_p, round(corr(a.z, b.z), 5) AS corr, CAST(count(*) AS DOUBLE) AS n
           FROM z a JOIN z b USING (test_id) GROUP BY 1, 2""",
        **WIDE,
        **SCALED,
    ),
)
def representation(spark, sf_dir):
    out = sc.standard_representation(ds.testday(spark, sf_dir), CURVE).correlation
    return out.filter("n > 0").withColumn("corr", F.round("corr", 5))


@query(
    "standard_representation_std",
    ds.with_views("testday", "SELECT g AS day, round(stddev_pop(z), 6) AS std FROM z GROUP BY 1", **WIDE, **SCALED),
)
def representation_std(spark, sf_dir):
    out = sc.standard_representation(ds.testday(spark, sf_dir), CURVE).std
    return out.withColumn("std", F.round("std", 6))


DIGEST = """test_id, count(*) AS filled, round(sum({v}), 4) AS total, round(sum(dim * {v}), 3) AS weighted"""


def _digest(df, column):
    return df.select("test_id", F.size(column).alias("slots"), daily.tally(F.col(column)).alias("_t")).select(
        "test_id",
        F.col("_t.seen").cast("int").alias("filled"),
        "slots",
        F.round("_t.total", 4).alias("total"),
        F.round("_t.weighted", 3).alias("weighted"),
    )


@query(
    "pivot_days",
    ds.with_views(
        "testday",
        """SELECT test_id, count(y) AS filled, 305 AS slots, round(coalesce(sum(y), 0), 4) AS total,
                  round(coalesce(sum(dim * y), 0), 3) AS weighted
           FROM (SELECT test_id, dim, CASE WHEN dim <= 305 THEN avg(milk_kg) END AS y FROM testday GROUP BY 1, 2) GROUP BY 1""",
    ),
)
def pivot(spark, sf_dir):
    return _digest(bp.pivot_days(ds.testday(spark, sf_dir)), "milk")


@query(
    "center_yields",
    ds.with_views(
        "testday",
        f"""SELECT test_id, dim, round(y - {g_sql("dim")}, 9) AS from_curve, round(y - avg(y) OVER (PARTITION BY dim), 9) AS from_mean
            FROM (SELECT test_id, dim, avg(milk_kg) AS y FROM testday WHERE dim <= 305 GROUP BY 1, 2)""",
    ),
)
def center(spark, sf_dir):
    records = ds.testday(spark, sf_dir)
    a = bp.center_yields(records, CURVE[1:]).withColumnRenamed("deviation", "from_curve")
    b = bp.center_yields(records).withColumnRenamed("deviation", "from_mean")
    out = a.join(b, ["test_id", "dim"])
    return out.withColumns({c: F.round(c, 9) for c in ("from_curve", "from_mean")})


@query(
    "ar1_matrix",
    """SELECT s_suppkey AS row_id, i, j, round(pow(0.5 + CAST(s_suppkey % 50 AS DOUBLE) / 100, abs(i - j)), 8) AS value
       FROM supplier CROSS JOIN (SELECT CAST(unnest(range(1, 13)) AS INTEGER) AS i) CROSS JOIN (SELECT CAST(unnest(range(1, 13)) AS INTEGER) AS j)""",
)
def ar1(spark, sf_dir):
    rows = ds.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("row_id"))
    rho = 0.5 + (F.col("row_id") % 50).cast("double") / 100
    return bp.ar1_matrix(rows, rho, size=12).withColumn("value", F.round("value", 8))


@query(
    "deviation_vector",
    ds.with_views(
        "testday",
        f"""SELECT test_id, 305 AS filled, 305 AS slots, round(sum(v), 4) AS total, round(sum(dim * v), 3) AS weighted
            FROM (SELECT test_id, dim, arg_max(milk_kg, pos) - {g_sql("dim")} AS v FROM testday WHERE dim <= 305 GROUP BY 1, 2) GROUP BY 1""",
    ),
)
def deviation(spark, sf_dir):
    return _digest(bp.deviation_vector(ds.testday(spark, sf_dir), CURVE[1:]), "deviation")


B1, B2 = 4.0, 25.0


@query(
    "best_prediction_yield",
    ds.with_views(
        "testday",
        # b1 * I + b2 * J has an inverse in closed form for any number of days
        f"""SELECT test_id, round((SELECT sum({g_sql("d")}) FROM (SELECT unnest(range(1, 306)) AS d))
                   + {B1 + 305 * B2} * coalesce(s, 0) / ({B1} + coalesce(n, 0) * {B2}), 3) AS yield_kg
            FROM (SELECT DISTINCT test_id FROM testday) LEFT JOIN (SELECT test_id, count(*) AS n, sum(v) AS s FROM one GROUP BY 1) USING (test_id)""",
        one=f"""SELECT test_id, dim, arg_max(milk_kg, pos) - {g_sql("dim")} AS v FROM testday WHERE dim <= 305 GROUP BY 1, 2""",
    ),
)
def best_prediction(spark, sf_dir):
    """All correlations 1, which SQL can follow; fading ones are checked against a brute-force solve in the tests."""
    out = bp.best_prediction_yield(ds.testday(spark, sf_dir), CURVE[1:], bp.ar1_covariance(B1, B2, 1.0))
    return out.withColumn("yield_kg", F.round("yield_kg", 3))


CANDIDATES = [(0.0, 0.9), (0.0, 0.98), (0.5, 1.0), (3.0, 1.0)]


@query(
    "ar1_log_likelihood",
    ds.with_views(
        "testday",
        # without a day effect the series is a Markov chain, with full correlation the matrix is ratio * I + J
        """SELECT CAST(k AS INTEGER) AS candidate, CAST(sum(n) AS DOUBLE) AS n, round(sum(log_det), 2) AS log_det, round(sum(quadratic), 2) AS quadratic FROM (
             SELECT k, count(*) AS n, sum(ln(CASE WHEN gap IS NULL THEN 1 ELSE 1 - pow(rho, 2 * gap) END)) AS log_det,
                    sum(CASE WHEN gap IS NULL THEN v * v ELSE pow(v - pow(rho, gap) * before, 2) / (1 - pow(rho, 2 * gap)) END) AS quadratic
             FROM chain, candidates WHERE rho < 1 GROUP BY k
             UNION ALL
             SELECT k, sum(m), sum((m - 1) * ln(ratio) + ln(ratio + m)), sum((q - s * s / (ratio + m)) / ratio)
             FROM (SELECT test_id, count(*) AS m, sum(v) AS s, sum(v * v) AS q FROM one GROUP BY 1), candidates WHERE rho = 1 GROUP BY k)
           GROUP BY 1""",
        one=f"""SELECT test_id, dim, arg_max(milk_kg, pos) - {g_sql("dim")} AS v FROM testday WHERE dim <= 305 GROUP BY 1, 2""",
        chain="""SELECT v, lag(v) OVER w AS before, dim - lag(dim) OVER w AS gap FROM one WINDOW w AS (PARTITION BY test_id ORDER BY dim)""",
        candidates="SELECT * FROM (VALUES "
        + ", ".join(f"({k}, {ratio}::DOUBLE, {rho}::DOUBLE)" for k, (ratio, rho) in enumerate(CANDIDATES))
        + ") AS c(k, ratio, rho)",
    ),
)
def likelihood(spark, sf_dir):
    out = bp.ar1_log_likelihood(bp.deviations(ds.testday(spark, sf_dir), CURVE[1:]), CANDIDATES)
    return out.withColumns({c: F.round(c, 2) for c in ("log_det", "quadratic")})


@query("fit_ar1_covariance")
def fit_covariance(spark, sf_dir):
    fit = bp.fit_ar1_covariance(ds.testday(spark, sf_dir), CURVE[1:])
    return spark.createDataFrame([(fit["b1"], fit["b2"], fit["rho"])], "b1 double, b2 double, rho double")
