"""Herd statistics over the test-day and lactation views."""

from __future__ import annotations

from pyspark.sql import functions as F

from dairyframe import datasets as ds
from dairyframe.operators import herd, yields
from dairyframe.plans import query
from dairyframe.plans.yields import PROFILE_SQL

FIVE = ("Achieved21Milk", "Achieved305Milk", "Achieved75Milk", "AchievedMilk", "DaysInMilk")
FLAGS = ("direct_305", "no_day_21", "no_day_75", "no_305", "many_dropped")

# A direct 305-day value on about a third of the records, zero (unusable) on some of them.
DIRECT_SQL = "CASE WHEN dim % 3 = 0 THEN (dim % 7) * milk_kg * 30 END"
LATEST_SQL = f"""
    SELECT test_id, arg_max(v, pos) AS direct_kg
    FROM (SELECT test_id, pos, {DIRECT_SQL} AS v FROM testday) WHERE v > 0 GROUP BY test_id"""


def _rounded(df, columns, digits=4):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _with_direct(df):
    value = F.when(F.col("dim") % 3 == 0, (F.col("dim") % 7) * F.col("milk_kg") * 30)
    return df.withColumn("direct_kg", value)


def _summary_sql(group: str, source: str) -> str:
    head = f"{group}, " if group else ""
    tail = f"GROUP BY {group}" if group else ""
    return f"""
        SELECT {head}lactations, round(a21, 4) AS "Achieved21Milk",
               round(CASE WHEN direct_305 THEN adirect ELSE acapped END, 4) AS "Achieved305Milk",
               round(a75, 4) AS "Achieved75Milk", round(aobs, 4) AS "AchievedMilk", round(adim, 4) AS "DaysInMilk",
               direct_305, c21 = 0 AS no_day_21, c75 = 0 AS no_day_75,
               (NOT direct_305 AND ccap = 0) AS no_305,
               (NOT direct_305 AND ccap > 0 AND (lactations - ccap) / lactations::DOUBLE > 0.2) AS many_dropped
        FROM (SELECT {head}count(*) AS lactations, avg(near_21) AS a21, avg(near_75) AS a75, avg(observed) AS aobs,
                     avg(capped) AS acapped, avg(direct_kg) AS adirect, avg(mean_dim) AS adim,
                     count(near_21) AS c21, count(near_75) AS c75, count(capped) AS ccap,
                     count(direct_kg) >= greatest(1, floor(0.8 * count(*))) AS direct_305
              FROM {source} {tail})"""


@query(
    "mean_near_dim",
    ds.with_views(
        "testday",
        """SELECT 21 AS day, round(avg(near_21), 4) AS mean_kg, count(near_21) AS lactations FROM p
           UNION ALL SELECT 75, round(avg(near_75), 4), count(near_75) FROM p""",
        p=PROFILE_SQL,
    ),
)
def mean_near_dim(spark, sf_dir):
    profile = yields.lactation_profile(ds.testday(spark, sf_dir))
    wide = profile.agg(
        *[f(name).alias(f"{kind}_{name}") for name in yields.NEAR_DAYS for kind, f in (("m", F.avg), ("n", F.count))]
    )
    return wide.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(day).alias("day"),
                        F.round(f"m_{name}", 4).alias("mean_kg"),
                        F.col(f"n_{name}").alias("lactations"),
                    )
                    for name, (day, _) in yields.NEAR_DAYS.items()
                ]
            )
        )
    )


@query(
    "mean_days_in_milk",
    ds.with_views(
        "testday cow",
        """SELECT herd_id, round(avg(m), 4) AS mean_dim, count(*) AS lactations
           FROM (SELECT test_id, avg(dim) AS m FROM testday GROUP BY 1) JOIN cow USING (test_id) GROUP BY 1""",
    ),
)
def mean_days(spark, sf_dir):
    per = ds.testday(spark, sf_dir).groupBy("test_id").agg(F.avg("dim").alias("m"))
    joined = per.join(ds.cow(spark, sf_dir).select("test_id", "herd_id"), "test_id")
    return joined.groupBy("herd_id").agg(
        F.round(F.avg("m"), 4).alias("mean_dim"), F.count(F.lit(1)).alias("lactations")
    )


@query(
    "latest_305_value",
    ds.with_views("testday", "SELECT test_id, round(direct_kg, 4) AS direct_kg FROM l", l=LATEST_SQL),
)
def latest_305(spark, sf_dir):
    out = herd.latest_direct_value(_with_direct(ds.testday(spark, sf_dir)))
    return out.filter(F.col("direct_kg").isNotNull()).select("test_id", F.round("direct_kg", 4).alias("direct_kg"))


@query(
    "yield_305_switch",
    ds.with_views(
        "testday cow",
        'SELECT herd_id, lactations, "Achieved305Milk", direct_305, no_305, many_dropped FROM s',
        p=PROFILE_SQL,
        l=LATEST_SQL,
        j="""SELECT p.*, cow.herd_id, CASE WHEN herd_id % 2 = 0 THEN l.direct_kg END AS direct_kg
             FROM p JOIN cow USING (test_id) LEFT JOIN l USING (test_id)""",
        s=_summary_sql("herd_id", "j"),
    ),
)
def switch(spark, sf_dir):
    records = ds.testday(spark, sf_dir)
    direct = herd.latest_direct_value(_with_direct(records))
    lactations = ds.cow(spark, sf_dir).join(direct, "test_id", "left")
    # Only every second herd reports direct values, so both branches of the switch are taken.
    lactations = lactations.withColumn("direct_kg", F.when(F.col("herd_id") % 2 == 0, F.col("direct_kg")))
    out = herd.herd_stats_summary(records, lactations, by=["herd_id"])
    return _rounded(out, ["Achieved305Milk"]).select(
        "herd_id", "lactations", "Achieved305Milk", "direct_305", "no_305", "many_dropped"
    )


@query(
    "herd_stats_summary",
    ds.with_views(
        "testday cow",
        "SELECT * FROM s",
        p=PROFILE_SQL,
        j="SELECT p.*, cow.herd_id, cow.parity, CAST(NULL AS DOUBLE) AS direct_kg FROM p JOIN cow USING (test_id)",
        s=_summary_sql("herd_id, parity", "j"),
    ),
)
def summary(spark, sf_dir):
    out = herd.herd_stats_summary(
        ds.testday(spark, sf_dir), ds.cow(spark, sf_dir), by=["herd_id", "parity"]
    )
    return _rounded(out, FIVE)


@query(
    "mode_parity",
    ds.with_views(
        "cow",
        """SELECT parity FROM (SELECT parity, count(*) AS n, min(test_id) AS seen FROM cow GROUP BY 1)
           ORDER BY n DESC, seen LIMIT 1""",
    ),
)
def mode(spark, sf_dir):
    return herd.mode_parity(ds.cow(spark, sf_dir))


# Ten raw statistics per customer, some out of range and some missing.
RAW_SQL = """
    SELECT c_custkey AS herd_id, v0 AS "Achieved21Milk", v1 AS "Achieved305Milk", v2 AS "Achieved75Milk",
           v3 AS "AchievedMilk", v4 AS "DaysDry", v5 AS "DaysInMilk", v6 AS "DaysOpen", v7 AS "DaysPregnant",
           v8 AS "HistoricCalvingInterval", v9 AS "QualitySequence"
    FROM (SELECT c_custkey, c_acctbal / 150 AS v0, c_acctbal * 2 AS v1, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal / 130 END AS v2,
                 c_acctbal * 3 AS v3, c_acctbal / 60 AS v4, c_acctbal / 12 AS v5, c_acctbal / 30 AS v6,
                 c_acctbal / 31 AS v7, c_acctbal / 15 AS v8, c_acctbal / 9000 AS v9 FROM customer)"""


def _raw_stats(spark, sf_dir):
    balance = F.col("c_acctbal")
    divisors = (150, None, 130, None, 60, 12, 30, 31, 15, 9000)
    factors = (None, 2, None, 3)
    columns = []
    for i, name in enumerate(herd.STAT_NAMES):
        value = balance / divisors[i] if divisors[i] else balance * factors[i]
        if name == "Achieved75Milk":
            value = F.when(F.col("c_custkey") % 5 != 0, value)
        columns.append(value.alias(name))
    return ds.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("herd_id"), *columns)


def _norm_sql(clamp: bool) -> str:
    cells = []
    for name, (lo, hi) in herd.STAT_RANGES.items():
        value = f"CASE WHEN \"{name}\" IS NOT NULL THEN greatest({lo}, least({hi}, \"{name}\")) END" if clamp else f'"{name}"'
        cells.append(f'({value} - {lo}) / ({hi} - {lo}) AS "{name}"')
    return f"SELECT herd_id, {', '.join(cells)} FROM raw"


@query("range_normalize", ds.with_views("", "SELECT * FROM n", raw=RAW_SQL, n=_norm_sql(True)))
def normalize(spark, sf_dir):
    return herd.normalize_stats(_raw_stats(spark, sf_dir))


@query(
    "range_denormalize",
    ds.with_views(
        "",
        "SELECT herd_id, "
        + ", ".join(f'(("{n}" - {lo}) / ({hi} - {lo})) * ({hi} - {lo}) + {lo} AS "{n}"' for n, (lo, hi) in herd.STAT_RANGES.items())
        + " FROM raw",
        raw=RAW_SQL,
    ),
)
def denormalize(spark, sf_dir):
    unclamped = herd.normalize_stats(_raw_stats(spark, sf_dir), clamp=False)
    return herd.denormalize_stats(unclamped)


@query(
    "column_means",
    "WITH raw AS ("
    + RAW_SQL
    + ") SELECT "
    + ", ".join(f'round(avg("{n}"), 4) AS "{n}", count(*) - count("{n}") AS "{n}_bad"' for n in herd.STAT_NAMES)
    + " FROM raw",
)
def means(spark, sf_dir):
    out = herd.column_means(_raw_stats(spark, sf_dir), herd.STAT_NAMES)
    return _rounded(out, herd.STAT_NAMES)


def _vector_rows(df, column, digits=6):
    return df.select("herd_id", F.posexplode(column).alias("slot", "value")).select(
        "herd_id", "slot", F.round("value", digits).alias("value")
    )


@query(
    "herd_stats_vector",
    "WITH raw AS ("
    + RAW_SQL
    + ") "
    + " UNION ALL ".join(
        f'SELECT herd_id, {i} AS slot, round(coalesce("{n}", 0), 6) AS value FROM raw' for i, n in enumerate(herd.STAT_NAMES)
    ),
)
def vector(spark, sf_dir):
    pairs = [item for n in herd.STAT_NAMES for item in (F.lit(n), F.col(n))]
    stats = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())
    return _vector_rows(_raw_stats(spark, sf_dir), herd.stats_vector(stats))


# An upload: some rows of other events, some unreadable, parity known for most.
REPORT_UPLOAD = dict(
    raw="""SELECT t.test_id, dim, milk_kg, pos, parity, dim % 19 = 0 AS other, CASE WHEN dim % 29 = 0 THEN 'no_id' WHEN dim % 23 = 0 THEN 'no_milk' END AS reason
           FROM base t JOIN cow USING (test_id)""",
    testday="SELECT test_id, dim, milk_kg, pos FROM raw WHERE NOT other AND reason IS NULL",
)


@query(
    "upload_report",
    ds.with_views(
        "cow",
        """SELECT row_count, other_events, rejected, no_id, no_milk, row_count - other_events - rejected AS usable, lactations, detected_parity,
                  "Achieved21Milk", "Achieved305Milk", "Achieved75Milk", "AchievedMilk", "DaysInMilk",
                  CAST(no_day_21 AS INTEGER) + CAST(no_day_75 AS INTEGER) + CAST(no_305 AS INTEGER) + CAST(many_dropped AS INTEGER) + 1 AS warnings
           FROM s, (SELECT count(*) AS row_count, count(*) FILTER (other) AS other_events, count(*) FILTER (NOT other AND reason IS NOT NULL) AS rejected,
                           count(*) FILTER (NOT other AND reason = 'no_id') AS no_id, count(*) FILTER (NOT other AND reason = 'no_milk') AS no_milk FROM raw),
                (SELECT parity AS detected_parity FROM (SELECT parity, count(*) AS n, min(seen) AS seen FROM (SELECT test_id, any_value(parity) AS parity, min(pos) AS seen
                 FROM raw WHERE NOT other AND reason IS NULL GROUP BY 1) GROUP BY 1) ORDER BY n DESC, seen LIMIT 1)""",
        base=ds.VIEWS["testday"],
        **REPORT_UPLOAD,
        p=PROFILE_SQL,
        j="SELECT p.*, CAST(NULL AS DOUBLE) AS direct_kg FROM p",
        s=_summary_sql("", "j"),
    ),
)
def report(spark, sf_dir):
    dim, tasks = F.col("dim"), ds.lactation_tasks(spark, sf_dir)
    # both sides are dealt alike, so the join and all groups by lactation above it share this one shuffle
    rows = ds.testday(spark, sf_dir).repartition(tasks, "test_id").join(ds.cow(spark, sf_dir).repartition(tasks, "test_id"), "test_id")
    reason = F.when(dim % 29 == 0, "no_id").when(dim % 23 == 0, "no_milk")
    out = herd.upload_report(rows.select("test_id", "dim", "milk_kg", "pos", "parity", (dim % 19 != 0).alias("event_ok"), reason.alias("reject_reason")))
    reasons = [F.col("reasons")[c].alias(c) for c in ("no_id", "no_milk")]
    return _rounded(out, FIVE).select(
        "row_count", "other_events", "rejected", *reasons, "usable", "lactations", "detected_parity", *FIVE, F.size("warnings").alias("warnings")
    )
