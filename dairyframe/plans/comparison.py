"""Comparison statistics of two yield methods against ground truth."""

from __future__ import annotations

from pyspark.sql import functions as F

from dairyframe import datasets as ds
from dairyframe.operators import comparison as cmp, lookups as lk, yields
from dairyframe.plans import query
from dairyframe.plans.joins import TRUTH_SQL, predicted, truth
from dairyframe.plans.yields import PROFILE_SQL, TEST_INTERVAL_SQL

STATS_SQL = """
    CASE WHEN count(*) >= 2 AND min(a) <> max(a) AND min(b) <> max(b) THEN round(corr(a, b), 6) END AS pearson,
    round(sqrt(avg((b - a) * (b - a))), 3) AS rmse, round(avg(abs(b - a)), 3) AS mae,
    round(sum(CASE WHEN b <> 0 THEN abs((b - a) / b) ELSE 0 END) / count(*) * 100, 3) AS mape, count(*) AS n"""
SETS = dict(
    challenger=TEST_INTERVAL_SQL,
    prof=PROFILE_SQL,
    benchmark="SELECT test_id, capped AS yield_kg FROM prof WHERE capped IS NOT NULL",
    truth=TRUTH_SQL,
    # parity is unknown for some lactations
    par="SELECT test_id, CASE WHEN test_id % 7 <> 0 THEN parity END AS parity FROM cow",
    pairs="""
        SELECT test_id, 'challenger_vs_aly' AS axis, x.yield_kg AS a, y.yield_kg AS b FROM challenger x JOIN truth y USING (test_id)
        UNION ALL SELECT test_id, 'benchmark_vs_aly', x.yield_kg, y.yield_kg FROM benchmark x JOIN truth y USING (test_id)
        UNION ALL SELECT test_id, 'challenger_vs_benchmark', x.yield_kg, y.yield_kg FROM challenger x JOIN benchmark y USING (test_id)""",
    grouped="""SELECT pairs.*, CASE WHEN coalesce(parity, 1) <= 2 THEN CAST(coalesce(parity, 1) AS VARCHAR) ELSE '3+' END AS g
               FROM pairs LEFT JOIN par USING (test_id)""",
)


def _benchmark(spark, sf_dir):
    return yields.trapezoid_capped(ds.testday(spark, sf_dir)).filter("yield_kg is not null")


def _parities(spark, sf_dir):
    return ds.cow(spark, sf_dir).select(
        "test_id", F.when(F.col("test_id") % 7 != 0, F.col("parity")).alias("parity")
    )


@query(
    "compare_stats",
    ds.with_views("testday aly cow", f"SELECT {STATS_SQL} FROM pairs WHERE axis = 'challenger_vs_aly'", **SETS),
)
def stats(spark, sf_dir):
    return cmp.compare_stats(lk.common_ids(predicted(spark, sf_dir), truth(spark, sf_dir)))


@query(
    "compare_by_parity",
    ds.with_views(
        "testday aly cow",
        f"""SELECT g AS parity_group, {STATS_SQL} FROM grouped WHERE axis = 'challenger_vs_aly' GROUP BY 1
            UNION ALL SELECT 'all', {STATS_SQL} FROM grouped WHERE axis = 'challenger_vs_aly'""",
        **SETS,
    ),
)
def by_parity(spark, sf_dir):
    pairs = lk.common_ids(predicted(spark, sf_dir), truth(spark, sf_dir))
    return cmp.compare_by_parity(pairs.join(_parities(spark, sf_dir), "test_id", "left"))


@query(
    "compare_three_axis",
    ds.with_views(
        "testday aly cow",
        f"""SELECT axis, g AS parity_group, {STATS_SQL}, CAST(NULL AS BIGINT) AS failed_count FROM grouped GROUP BY 1, 2
            UNION ALL SELECT axis, 'all', {STATS_SQL}, (SELECT count(*) FROM challenger WHERE test_id NOT IN (SELECT test_id FROM truth))
            FROM grouped GROUP BY 1""",
        **SETS,
    ),
)
def three_axis(spark, sf_dir):
    return cmp.compare_three_axis(
        predicted(spark, sf_dir), _benchmark(spark, sf_dir), truth(spark, sf_dir), _parities(spark, sf_dir)
    )


@query(
    "compare_two_block",
    ds.with_views(
        "testday aly cow",
        f"""SELECT axis2 AS axis, g AS parity_group, {STATS_SQL}, CAST(NULL AS BIGINT) AS failed_count FROM two GROUP BY 1, 2
            UNION ALL SELECT axis2, 'all', {STATS_SQL}, (SELECT count(*) FROM challenger WHERE test_id NOT IN (SELECT test_id FROM benchmark))
            FROM two GROUP BY 1""",
        **SETS,
        two="""SELECT *, CASE axis WHEN 'challenger_vs_aly' THEN 'vs_aly' ELSE 'vs_reference' END AS axis2 FROM grouped
               WHERE axis <> 'benchmark_vs_aly'""",
    ),
)
def two_block(spark, sf_dir):
    return cmp.compare_two_block(
        predicted(spark, sf_dir), _benchmark(spark, sf_dir), _parities(spark, sf_dir), truth(spark, sf_dir)
    )


@query(
    "report_pairs",
    ds.with_views(
        "testday aly cow",
        """SELECT axis, g AS parity_group, test_id, round(a, 4) AS a_kg, round(b, 4) AS b_kg,
                  round(0.97 * min(least(a, b)) OVER w, 4) AS axis_low, round(1.03 * max(greatest(a, b)) OVER w, 4) AS axis_high,
                  count(*) OVER w AS evaluated
           FROM grouped WINDOW w AS (PARTITION BY axis, g)""",
        **SETS,
    ),
)
def report(spark, sf_dir):
    out = cmp.report_pairs(
        predicted(spark, sf_dir), _benchmark(spark, sf_dir), truth(spark, sf_dir), _parities(spark, sf_dir)
    )
    return out.withColumns({c: F.round(c, 4) for c in ("a_kg", "b_kg", "axis_low", "axis_high")})


@query(
    "failed_count",
    ds.with_views(
        "testday aly cow",
        "SELECT count(*) AS failed_count FROM challenger WHERE test_id NOT IN (SELECT test_id FROM truth)",
        **SETS,
    ),
)
def failed_count(spark, sf_dir):
    return cmp.failed_count(predicted(spark, sf_dir), truth(spark, sf_dir))


@query(
    "cohort_summary",
    ds.with_views(
        "testday aly cow",
        """SELECT 'records' AS measure, count(*) AS n FROM testday UNION ALL SELECT 'lactations', count(*) FROM par
           UNION ALL SELECT 'yields', count(*) FROM truth UNION ALL SELECT 'herds', nullif(count(DISTINCT herd_id), 0) FROM cow
           UNION ALL SELECT 'parity:' || coalesce(CAST(parity AS VARCHAR), 'unknown'), count(*) FROM par GROUP BY parity""",
        **SETS,
    ),
)
def cohort(spark, sf_dir):
    lactations = _parities(spark, sf_dir).join(ds.cow(spark, sf_dir).select("test_id", "herd_id"), "test_id")
    return cmp.cohort_summary(ds.testday(spark, sf_dir), lactations, truth(spark, sf_dir))


@query(
    "label_counts",
    """SELECT coalesce(CAST(quality AS VARCHAR), 'unknown') AS label, count(*) AS n
       FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""",
)
def labels(spark, sf_dir):
    docs = ds.table(spark, sf_dir, "documents").select("doc_id")
    return cmp.label_counts(docs.join(ds.table(spark, sf_dir, "labels"), "doc_id", "left"), "quality")
