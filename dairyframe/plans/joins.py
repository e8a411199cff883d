"""Cohort joins and lookups over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dairyframe import datasets as ds
from dairyframe.operators import lookups as lk, yields
from dairyframe.plans import query
from dairyframe.plans.yields import TEST_INTERVAL_SQL

# a tenth of the ground truth carries ids of no lactation, so that both sides miss some
TRUTH_SQL = "SELECT CASE WHEN test_id % 10 < 9 THEN test_id ELSE -1 - test_id END AS test_id, yield_kg FROM aly"
PREDICTED = dict(pred=TEST_INTERVAL_SQL, truth=TRUTH_SQL)


def predicted(spark, sf_dir):
    return yields.test_interval_yield(ds.testday(spark, sf_dir))


def truth(spark, sf_dir):
    test_id = F.col("test_id")
    return ds.aly(spark, sf_dir).withColumn("test_id", F.when(test_id % 10 < 9, test_id).otherwise(-1 - test_id))


@query(
    "join_common_ids",
    ds.with_views(
        "testday aly",
        """SELECT test_id, round(pred.yield_kg, 4) AS a_kg, truth.yield_kg AS b_kg FROM pred JOIN truth USING (test_id)""",
        **PREDICTED,
    ),
)
def common(spark, sf_dir):
    out = lk.common_ids(predicted(spark, sf_dir), truth(spark, sf_dir))
    return out.withColumn("a_kg", F.round("a_kg", 4))


@query(
    "join_failed_ids",
    ds.with_views(
        "testday aly",
        """SELECT 'without_prediction' AS kind, test_id FROM truth WHERE test_id NOT IN (SELECT test_id FROM pred)
           UNION ALL SELECT 'without_truth', test_id FROM pred WHERE test_id NOT IN (SELECT test_id FROM truth)""",
        **PREDICTED,
    ),
)
def failed(spark, sf_dir):
    pred, known = predicted(spark, sf_dir), truth(spark, sf_dir)
    return (
        lk.ids_without(known, pred)
        .withColumn("kind", F.lit("without_prediction"))
        .unionByName(lk.ids_without(pred, known).withColumn("kind", F.lit("without_truth")))
    )


@query(
    "join_keep_with_truth",
    ds.with_views("testday aly", "SELECT test_id, dim, milk_kg FROM testday WHERE test_id IN (SELECT test_id FROM truth)", truth=TRUTH_SQL),
)
def keep(spark, sf_dir):
    cohort = ds.testday(spark, sf_dir).select("test_id", "dim", "milk_kg")
    return cohort.join(truth(spark, sf_dir).select("test_id"), "test_id", "left_semi")


@query(
    "set_common_ids",
    ds.with_views(
        "testday aly",
        """SELECT test_id, CASE WHEN p.test_id IS NULL THEN 'right' WHEN t.test_id IS NULL THEN 'left' ELSE 'both' END AS side
           FROM pred p FULL JOIN truth t USING (test_id)""",
        **PREDICTED,
    ),
)
def set_ids(spark, sf_dir):
    return lk.shared_and_single_ids(predicted(spark, sf_dir), truth(spark, sf_dir))


def users(spark, sf_dir):
    return ds.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.col("c_name").alias("user_name"),
        F.concat(F.lit("u"), F.col("c_custkey").cast("string"), F.lit("@Farm.example")).alias("user_email"),
    )


def organizations(spark, sf_dir):
    return ds.table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("organization_id"), F.col("n_name").alias("organization_name")
    )


USERS_SQL = "SELECT c_custkey AS user_id, c_name AS user_name, 'u' || c_custkey || '@Farm.example' AS user_email FROM customer"
ORGS_SQL = "SELECT CAST(n_nationkey AS BIGINT) AS organization_id, n_name AS organization_name FROM nation"


@query(
    "join_owner_outer",
    f"""SELECT o_orderkey AS record_id, user_id, organization_id, user_name, user_email, organization_name
        FROM (SELECT o_orderkey, CASE WHEN o_custkey % 9 <> 0 THEN o_custkey END AS user_id, o_custkey % 28 AS organization_id FROM orders)
        LEFT JOIN ({USERS_SQL}) USING (user_id) LEFT JOIN ({ORGS_SQL}) USING (organization_id)""",
)
def owners(spark, sf_dir):
    cust = F.col("o_custkey")
    records = ds.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("record_id"),
        F.when(cust % 9 != 0, cust).alias("user_id"),
        (cust % 28).alias("organization_id"),
    )
    return lk.with_owner(records, users(spark, sf_dir), organizations(spark, sf_dir))


MEMBERS_SQL = f"""
    SELECT DISTINCT o_custkey AS user_id, (o_custkey + o_orderkey % 3) % 25 AS organization_id,
           CASE WHEN o_custkey % 7 = 0 THEN 'owner' ELSE 'member' END AS role FROM orders"""


def memberships(spark, sf_dir):
    cust = F.col("o_custkey")
    return (
        ds.table(spark, sf_dir, "orders")
        .select(
            cust.alias("user_id"),
            ((cust + F.col("o_orderkey") % 3) % 25).alias("organization_id"),
            F.when(cust % 7 == 0, "owner").otherwise("member").alias("role"),
        )
        .distinct()
    )


@query(
    "join_membership",
    f"""SELECT user_id, user_name, string_agg(organization_name || ':' || role, ',' ORDER BY organization_name) AS memberships
        FROM ({MEMBERS_SQL}) JOIN ({USERS_SQL}) USING (user_id) JOIN ({ORGS_SQL}) USING (organization_id) GROUP BY 1, 2""",
)
def membership(spark, sf_dir):
    members = lk.members_of(memberships(spark, sf_dir), users(spark, sf_dir), organizations(spark, sf_dir))
    out = lk.memberships_per_user(members)
    entry = F.transform("memberships", lambda m: F.concat_ws(":", m["organization_name"], m["role"]))
    return out.select("user_id", "user_name", F.array_join(entry, ",").alias("memberships"))


LEVEL_SQL = dict(
    y="SELECT herd_id, parity, yield_kg FROM aly JOIN cow USING (test_id)",
    # some statistics are those of herds and parities that no record asks for
    l1="SELECT CASE WHEN herd_id % 3 <> 0 AND parity < 5 THEN herd_id ELSE -1 - herd_id END AS herd_id, parity, round(sum(yield_kg), 2) / count(*) AS v FROM y GROUP BY 1, 2",
    l2="SELECT CASE WHEN herd_id % 4 <> 0 THEN herd_id ELSE -1 - herd_id END AS herd_id, round(sum(yield_kg), 2) / count(*) AS v FROM y GROUP BY 1",
    l3="SELECT CASE WHEN parity <> 2 THEN parity ELSE 99 END AS parity, round(sum(yield_kg), 2) / count(*) AS v FROM y GROUP BY 1",
    rec="""SELECT test_id, CASE WHEN test_id % 11 <> 0 THEN herd_id END AS herd_id, CASE WHEN test_id % 13 <> 0 THEN parity END AS parity,
                  CASE WHEN test_id % 17 = 0 THEN 1.5 END AS given FROM cow""",
)


@query(
    "lookup_hierarchical",
    ds.with_views(
        "aly cow",
        """SELECT test_id, coalesce(given, l1.v, l2.v, l3.v, 7000.0) AS achieved,
                  CASE WHEN given IS NOT NULL THEN 0 WHEN l1.v IS NOT NULL THEN 1 WHEN l2.v IS NOT NULL THEN 2
                       WHEN l3.v IS NOT NULL THEN 3 ELSE 4 END AS stats_level
           FROM rec LEFT JOIN l1 ON l1.herd_id = rec.herd_id AND l1.parity = rec.parity
           LEFT JOIN l2 ON l2.herd_id = rec.herd_id LEFT JOIN l3 ON l3.parity = rec.parity""",
        **LEVEL_SQL,
    ),
)
def hierarchical(spark, sf_dir):
    cows = ds.cow(spark, sf_dir)
    rows = ds.aly(spark, sf_dir).join(cows, "test_id")
    stats = F.create_map(F.lit("AchievedMilk"), F.round(F.sum("yield_kg"), 2) / F.count(F.lit(1))).alias("stats")
    herd_id = F.col("herd_id")
    in_pair = F.when((herd_id % 3 != 0) & (F.col("parity") < 5), herd_id).otherwise(-1 - herd_id)
    in_herd = F.when(herd_id % 4 != 0, herd_id).otherwise(-1 - herd_id)
    in_parity = F.when(F.col("parity") != 2, F.col("parity")).otherwise(99)
    pair = rows.groupBy(in_pair.alias("herd_id"), "parity").agg(stats)
    herd = rows.groupBy(in_herd.alias("herd_id")).agg(stats)
    parity = rows.groupBy(in_parity.alias("parity")).agg(stats)
    test_id = F.col("test_id")
    records = cows.select(
        "test_id",
        # ids arrive as text with a decimal point, as a JSON document may carry them
        F.when(test_id % 11 != 0, F.concat(F.col("herd_id").cast("string"), F.lit(".0"))).alias("herd_id"),
        F.when(test_id % 13 != 0, F.col("parity")).alias("parity"),
        F.when(test_id % 17 == 0, F.create_map(F.lit("AchievedMilk"), F.lit(1.5))).alias("stats"),
    )
    out = lk.hierarchical_stats(records, pair, herd, parity, {"AchievedMilk": 7000.0})
    return out.select("test_id", F.col("stats")["AchievedMilk"].alias("achieved"), "stats_level")


EVENT_INDEX = {"pad": 0, "view": 1, "click": 2, "purchase": 3, "unknown": 4}


@query(
    "lookup_event_token",
    """SELECT event_id, CASE lower(CASE WHEN event_id % 10 <> 0 THEN upper(event_type) END)
              WHEN 'pad' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END AS token FROM events""",
)
def tokens(spark, sf_dir):
    event = F.when(F.col("event_id") % 10 != 0, F.upper("event_type"))
    return ds.table(spark, sf_dir, "events").select(
        "event_id", F.explode(lk.event_tokens(F.array(event), EVENT_INDEX)).alias("token")
    )


@query(
    "lookup_standard_curve",
    ds.with_views(
        "testday",
        "SELECT test_id, dim, pos, CASE WHEN dim <= 305 THEN 40 - (20.0::DOUBLE * dim) / 305 END AS expected_kg FROM testday",
    ),
)
def standard_curve(spark, sf_dir):
    curve = [40 - 20.0 * day / 305 for day in range(306)]
    return ds.testday(spark, sf_dir).select(
        "test_id", "dim", "pos", lk.curve_value(curve, F.col("dim")).alias("expected_kg")
    )


def _prior_cells() -> str:
    cells = []
    for name in lk.PRIOR_NAMES:
        for i, kind in enumerate(("mean", "sd")):
            one, two, three = (lk.PRIORS[p][name][i] for p in (1, 2, 3))
            cells.append(f"CAST(CASE parity WHEN 1 THEN {one} WHEN 2 THEN {two} ELSE {three} END AS DOUBLE) AS {name}_{kind}")
    return ", ".join(cells)


@query(
    "lookup_priors",
    ds.with_views("cow", f"SELECT test_id, {_prior_cells()}, CAST({lk.SE_MILK} AS DOUBLE) AS se_milk FROM cow"),
)
def priors(spark, sf_dir):
    return ds.cow(spark, sf_dir).select("test_id", *lk.priors(F.col("parity")))
