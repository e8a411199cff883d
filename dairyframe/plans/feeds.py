"""Lists, search and the activity feed; four record kinds from orders, customers, suppliers and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from dairyframe import datasets as ds
from dairyframe.functions import text as tx
from dairyframe.operators import feed as fd, lookups as lk
from dairyframe.plans import query
from dairyframe.plans.joins import MEMBERS_SQL, ORGS_SQL, USERS_SQL, memberships, organizations, users

SUBMISSIONS_SQL = """
    SELECT 'benchmark_submission' AS item_type, 'Benchmark submission' AS item_type_label, CAST(o_orderkey AS VARCHAR) AS item_id,
           o_custkey % 28 AS organization_id, CASE WHEN o_custkey % 9 <> 0 THEN o_custkey END AS user_id, o_orderpriority AS title,
           o_orderdate AS created_at, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'ready' ELSE 'failed' END AS status,
           'benchmark' AS source, CAST(o_orderkey % 4 AS INTEGER) AS failed_count FROM orders"""
CHALLENGES_SQL = """
    SELECT 'benchmark_challenge', 'Benchmark challenge', CAST(c_custkey AS VARCHAR), CAST(c_nationkey AS BIGINT), c_custkey, c_name,
           TIMESTAMP '1999-01-01' + to_days(CAST(c_custkey % 700 AS INTEGER)), 'ready', c_mktsegment, 0 FROM customer"""
UPLOADS_SQL = """
    SELECT 'herd_dataset_upload', 'Herd dataset upload', CAST(s_suppkey AS VARCHAR), CAST(s_nationkey AS BIGINT), s_suppkey, s_name,
           TIMESTAMP '2000-01-01' + to_days(CAST(s_suppkey % 900 AS INTEGER)), CASE WHEN s_suppkey % 3 > 0 THEN 'warning' ELSE 'ready' END,
           'test_day', CAST(s_suppkey % 3 AS INTEGER) FROM supplier"""
PROFILES_SQL = """
    SELECT 'herd_profile', 'Herd profile', CAST(p_partkey AS VARCHAR), CAST(p_size AS BIGINT), NULL, p_name,
           CASE WHEN p_partkey % 10 <> 0 THEN TIMESTAMP '1998-06-01' + to_days(CAST(p_partkey % 500 AS INTEGER)) END, 'ready', 'herd profile', 0
    FROM part"""
FEED = dict(
    u=USERS_SQL,
    o=ORGS_SQL,
    items=" UNION ALL ".join((SUBMISSIONS_SQL, CHALLENGES_SQL, UPLOADS_SQL, PROFILES_SQL)),
    feed="""SELECT items.*, u.user_name, u.user_email, o.organization_name, (failed_count > 0 OR status NOT IN ('ready', 'completed')) AS problem
            FROM items LEFT JOIN u USING (user_id) LEFT JOIN o USING (organization_id)""",
)


def _after(date: str, days):
    return F.timestamp_add("DAY", days.cast("int"), F.lit(date).cast("timestamp"))


def items(spark, sf_dir):
    c = F.col
    status = c("o_orderstatus")
    submissions = ds.table(spark, sf_dir, "orders").select(
        c("o_orderkey").cast("string").alias("item_id"),
        (c("o_custkey") % 28).alias("organization_id"),
        F.when(c("o_custkey") % 9 != 0, c("o_custkey")).alias("user_id"),
        c("o_orderpriority").alias("title"),
        c("o_orderdate").cast("timestamp").alias("created_at"),
        F.when(status == "F", "completed").when(status == "O", "ready").otherwise("failed").alias("status"),
        F.lit("benchmark").alias("source"),
        (c("o_orderkey") % 4).cast("int").alias("failed_count"),
    )
    challenges = ds.table(spark, sf_dir, "customer").select(
        c("c_custkey").cast("string").alias("item_id"),
        c("c_nationkey").cast("bigint").alias("organization_id"),
        c("c_custkey").alias("user_id"),
        c("c_name").alias("title"),
        _after("1999-01-01", c("c_custkey") % 700).alias("created_at"),
        F.lit("ready").alias("status"),
        c("c_mktsegment").alias("source"),
        F.lit(0).alias("failed_count"),
    )
    warnings = (c("s_suppkey") % 3).cast("int")
    uploads = ds.table(spark, sf_dir, "supplier").select(
        c("s_suppkey").cast("string").alias("item_id"),
        c("s_nationkey").cast("bigint").alias("organization_id"),
        c("s_suppkey").alias("user_id"),
        c("s_name").alias("title"),
        _after("2000-01-01", c("s_suppkey") % 900).alias("created_at"),
        fd.upload_status(warnings).alias("status"),
        F.lit("test_day").alias("source"),
        warnings.alias("failed_count"),
    )
    profiles = ds.table(spark, sf_dir, "part").select(
        c("p_partkey").cast("string").alias("item_id"),
        c("p_size").cast("bigint").alias("organization_id"),
        c("p_name").alias("title"),
        F.when(c("p_partkey") % 10 != 0, _after("1998-06-01", c("p_partkey") % 500)).alias("created_at"),
        F.lit("ready").alias("status"),
        F.lit("herd profile").alias("source"),
        F.lit(0).alias("failed_count"),
    )
    kinds = dict(zip(fd.CATEGORIES, (submissions, challenges, uploads, profiles)))
    return fd.feed_union(kinds)


def feed(spark, sf_dir):
    """The feed with the names of its owners."""
    return lk.with_owner(items(spark, sf_dir), users(spark, sf_dir), organizations(spark, sf_dir))


SHOWN = ("item_type", "item_id", "title", "organization_name", "user_email", "status", "created_at")


@query(
    "feed_union",
    ds.with_views(
        "",
        f"""SELECT {", ".join(SHOWN)} FROM feed
            WHERE (contains(lower(title), 'er#00') OR contains(lower(item_type_label), 'er#00') OR contains(lower(organization_name), 'er#00')
                   OR contains(lower(user_email), 'er#00') OR contains(lower(user_name), 'er#00') OR contains(lower(status), 'er#00') OR contains(lower(source), 'er#00'))
              AND created_at >= TIMESTAMP '1996-01-01' AND created_at <= TIMESTAMP '2001-12-31'
            ORDER BY organization_name DESC NULLS LAST, created_at DESC, item_type, item_id""",
        **FEED,
    ),
)
def union(spark, sf_dir):
    found = fd.feed_filter(feed(spark, sf_dir), needle="ER#00", created_from="1996-01-01", created_to="2001-12-31")
    return fd.feed_top(found, sort="organization").select(*SHOWN)


@query("feed_problem_flag", ds.with_views("", "SELECT item_type, item_id, status, problem FROM feed", **FEED))
def problem(spark, sf_dir):
    return items(spark, sf_dir).select("item_type", "item_id", "status", "problem")


COUNTS_SQL = ", ".join(f"count(*) FILTER (WHERE item_type = '{k}') AS {k}s" for k in fd.CATEGORIES)


@query(
    "feed_kpis",
    ds.with_views(
        "",
        f"""SELECT count(*) AS total_items, count(DISTINCT nullif(organization_id, 0)) AS organizations, count(DISTINCT nullif(user_id, 0)) AS users,
                   {COUNTS_SQL}, count(*) FILTER (WHERE problem) AS failed_items, max(created_at) AS latest_activity_at FROM feed""",
        **FEED,
    ),
)
def kpis(spark, sf_dir):
    return fd.feed_kpis(items(spark, sf_dir))


@query(
    "feed_by_org",
    ds.with_views(
        "",
        f"""SELECT organization_id, coalesce(max(organization_name), 'Unknown organization') AS organization_name, count(*) AS total_items,
                   count(DISTINCT user_id) AS user_count, {COUNTS_SQL}, count(*) FILTER (WHERE problem) AS failed_items,
                   max(created_at) AS latest_activity_at FROM feed GROUP BY 1""",
        **FEED,
    ),
)
def by_org(spark, sf_dir):
    return fd.feed_by_org(feed(spark, sf_dir))


@query(
    "feed_by_category",
    ds.with_views(
        "",
        """SELECT k.item_type, k.label, count(feed.item_id) AS count, count(feed.item_id) FILTER (WHERE problem) AS failed_count,
                  max(created_at) AS latest_activity_at
           FROM (VALUES ('benchmark_submission', 'Benchmark submission'), ('benchmark_challenge', 'Benchmark challenge'),
                        ('herd_dataset_upload', 'Herd dataset upload'), ('herd_profile', 'Herd profile')) AS k(item_type, label)
           LEFT JOIN feed USING (item_type) GROUP BY 1, 2""",
        **FEED,
    ),
)
def by_category(spark, sf_dir):
    return fd.feed_by_category(items(spark, sf_dir))


STATS_JSON_SQL = """
    CASE o_orderkey % 5 WHEN 0 THEN '{"challenger_vs_aly": {"overall": {"rmse": ' || (o_orderkey % 97) || '.5, "pearson": 0.5}}}'
         WHEN 1 THEN '{"overall": {"pearson": 0.' || (o_orderkey % 90 + 10) || '}}'
         WHEN 2 THEN '{"vs_aly": {"overall": {"rmse": ' || (o_orderkey % 31) || '}}}' WHEN 3 THEN '{"overall": null}' END"""


@query(
    "feed_primary_metric",
    """SELECT o_orderkey AS record_id, CASE o_orderkey % 5 WHEN 0 THEN 'RMSE' WHEN 1 THEN 'Pearson' WHEN 2 THEN 'RMSE' END AS label,
              CAST(CASE o_orderkey % 5 WHEN 0 THEN (o_orderkey % 97) || '.5' WHEN 1 THEN '0.' || (o_orderkey % 90 + 10)
                   WHEN 2 THEN CAST(o_orderkey % 31 AS VARCHAR) END AS DOUBLE) AS value FROM orders""",
)
def metric(spark, sf_dir):
    rows = ds.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), F.expr(STATS_JSON_SQL).alias("stats"))
    return rows.select("record_id", fd.primary_metric(F.col("stats")).alias("m")).select("record_id", "m.label", "m.value")


RECORDS_SQL = """
    SELECT o_orderkey AS record_id, o_custkey % 28 AS organization_id, o_custkey AS user_id, o_orderpriority || ' ' || o_orderkey AS name,
           c_name AS user_name, o_orderdate AS created_at, CASE o_orderkey % 3 WHEN 0 THEN 'wood' WHEN 1 THEN 'milkbot' ELSE 'wilmink' END AS model,
           CASE WHEN o_orderstatus = 'O' THEN 'upload' ELSE 'preset' END AS source
    FROM orders JOIN customer ON o_custkey = c_custkey"""


def _records(spark, sf_dir):
    c = F.col
    key = c("o_orderkey")
    rows = ds.table(spark, sf_dir, "orders").select(
        key.alias("record_id"),
        (c("o_custkey") % 28).alias("organization_id"),
        c("o_custkey").alias("user_id"),
        F.concat("o_orderpriority", F.lit(" "), key.cast("string")).alias("name"),
        c("o_orderdate").cast("timestamp").alias("created_at"),
        F.when(key % 3 == 0, "wood").when(key % 3 == 1, "milkbot").otherwise("wilmink").alias("model"),
        F.when(c("o_orderstatus") == "O", "upload").otherwise("preset").alias("source"),
    )
    return rows.join(users(spark, sf_dir).select("user_id", "user_name"), "user_id")


@query(
    "list_filter_sort",
    f"""SELECT record_id, name, user_name, created_at FROM ({RECORDS_SQL}) WHERE organization_id = 7 AND contains(name, 'HIGH')
        ORDER BY user_name ASC, record_id""",
)
def listing(spark, sf_dir):
    out = fd.list_filter_sort(_records(spark, sf_dir), organization_id=7, contains="HIGH", sort="user", direction="asc")
    return out.select("record_id", "name", "user_name", "created_at")


@query(
    "list_page",
    f"""SELECT record_id, model, source, created_at FROM ({RECORDS_SQL}) WHERE model = 'wood' AND source = 'upload'
        ORDER BY created_at DESC, record_id LIMIT 50 OFFSET 100""",
)
def page(spark, sf_dir):
    out = fd.list_page(_records(spark, sf_dir), model="wood", source="upload", limit=50, offset=100)
    return out.select("record_id", "model", "source", "created_at")


@query(
    "search_users",
    f"SELECT user_id, user_name, user_email FROM ({USERS_SQL}) WHERE user_email ILIKE '%U12%' OR user_name ILIKE '%U12%'",
)
def search(spark, sf_dir):
    return fd.search_users(users(spark, sf_dir), "U12").select("user_id", "user_name", "user_email")


@query(
    "role_counts",
    f"""SELECT organization_id, count(*) FILTER (WHERE role = 'owner') AS owners FROM ({MEMBERS_SQL}) GROUP BY 1
        UNION ALL SELECT NULL, count(*) FILTER (WHERE user_id % 50 = 0) FROM ({USERS_SQL})""",
)
def roles(spark, sf_dir):
    role = F.when(F.col("user_id") % 50 == 0, "admin").otherwise("user")
    admins = fd.admin_count(users(spark, sf_dir).withColumn("role", role))
    everywhere = admins.select(F.lit(None).cast("bigint").alias("organization_id"), F.col("admins").alias("owners"))
    return fd.owner_counts(memberships(spark, sf_dir)).unionByName(everywhere)


@query(
    "text_functions",
    f"""SELECT user_id, lower(split_part(user_email, '@', -1)) AS domain,
               coalesce(nullif(trim(regexp_replace(trim(user_name), '[^A-Za-z0-9_.=-]+', '-', 'g'), '-'), ''), 'unnamed') AS safe_name,
               CASE WHEN size >= 1048576 THEN CASE WHEN size % 1048576 = 0 THEN (size // 1048576) || ' MB' ELSE printf('%.1f MB', size / 1048576) END
                    WHEN size >= 1024 THEN CASE WHEN size % 1024 = 0 THEN (size // 1024) || ' KB' ELSE printf('%.1f KB', size / 1024) END
                    ELSE size || ' bytes' END AS size_text,
               sha256(user_email) AS token
        FROM (SELECT *, user_id * 1536 AS size FROM ({USERS_SQL}))""",
)
def texts(spark, sf_dir):
    return users(spark, sf_dir).select(
        "user_id",
        tx.email_domain(F.col("user_email")).alias("domain"),
        tx.safe_path_part(F.col("user_name")).alias("safe_name"),
        tx.byte_text(F.col("user_id") * 1536).alias("size_text"),
        F.sha2("user_email", 256).alias("token"),
    )


@query(
    "display_texts",
    """SELECT c_custkey AS item_id, printf('%.2f', c_acctbal) AS kg_text, format('{:,.2f}', c_acctbal * 2.20462::DOUBLE) AS lbs_text,
              'lbs/day' AS unit, CASE WHEN c_custkey % 3 = 1 THEN c_name WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'Untitled' END AS title,
              greatest(TIMESTAMP '2020-01-01' + to_days(CAST(c_custkey % 50 AS INTEGER)),
                       CASE WHEN c_custkey % 4 > 0 THEN TIMESTAMP '2020-01-20' + to_days(CAST(c_custkey % 7 AS INTEGER)) END) AS latest
       FROM customer""",
)
def display(spark, sf_dir):
    """Weights in both units, the unit's label, the first title that is not empty, the later of two times."""
    c, key = F.col, F.col("c_custkey")
    title = tx.first_text(F.when(key % 3 == 1, c("c_name")).when(key % 3 == 2, ""), F.when(key % 2 == 0, c("c_mktsegment")), F.lit("Untitled"))
    checked = F.when(key % 4 > 0, _after("2020-01-20", key % 7))
    return ds.table(spark, sf_dir, "customer").select(
        key.alias("item_id"),
        tx.weight_text(c("c_acctbal"), "kg", 2).alias("kg_text"),
        tx.weight_text(c("c_acctbal"), "lbs", 2).alias("lbs_text"),
        tx.unit_label(F.lit("kg/day"), "lbs").alias("unit"),
        title.alias("title"),
        fd.latest_of(_after("2020-01-01", key % 50), checked).alias("latest"),
    )
