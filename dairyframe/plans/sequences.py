"""Sequence transforms, samples and model-ready rows."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from dairyframe import datasets as ds
from dairyframe.functions import arrays as ar, daily
from dairyframe.operators import alignment as al, features as ft, sampling
from dairyframe.plans import query
from dairyframe.plans.joins import EVENT_INDEX


def _rows(df, column, key="user_id", digits=6, base=1):
    return df.select(key, F.posexplode(column).alias("p", "v")).select(
        key, (F.col("p") + base).alias("day"), F.round("v", digits).alias("value")
    )


def _impute(name: str, value, sql: str) -> None:
    @query(name, ds.with_views("daily", f"SELECT user_id, day, round({sql}, 9) AS value FROM w", w=WINDOWED))
    def run(spark, sf_dir):
        return _rows(ds.daily(spark, sf_dir), value(F.col("milk")), digits=9)


WINDOWED = """
    SELECT user_id, day, value, last_value(value IGNORE NULLS) OVER up AS lv, last_value(CASE WHEN value IS NOT NULL THEN day END IGNORE NULLS) OVER up AS ld,
           first_value(value IGNORE NULLS) OVER down AS rv, first_value(CASE WHEN value IS NOT NULL THEN day END IGNORE NULLS) OVER down AS rd,
           first_value(value IGNORE NULLS) OVER whole AS fv, last_value(value IGNORE NULLS) OVER whole AS ev,
           avg(value) OVER (PARTITION BY user_id) AS mean
    FROM daily WINDOW up AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      down AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
      whole AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""
LINEAR = "CASE WHEN ld <> rd THEN lv + (rv - lv) * (CAST(day - ld AS DOUBLE) / (rd - ld)) ELSE coalesce(lv, rv) END"

_impute("impute_ffill", ar.forward_fill, "lv")
_impute("impute_ffill_edges", lambda x: ar.forward_fill(x, fill_edges=True), "coalesce(lv, fv, 0)")
_impute("impute_bfill", ar.backward_fill, "rv")
_impute("impute_bfill_edges", lambda x: ar.backward_fill(x, fill_edges=True), "coalesce(rv, ev, 0)")
_impute("impute_linear", ar.linear, LINEAR)
_impute("impute_zero", ar.fill_zero, "coalesce(value, 0)")
_impute("impute_mean", ar.fill_mean, "coalesce(value, mean)")


@query(
    "missing_day_count",
    ds.with_views(
        "daily testday",
        """SELECT 'daily' AS kind, user_id AS id, count(*) - count(value) AS missing FROM daily GROUP BY user_id
           UNION ALL SELECT 'periodic', test_id, 304 - count(DISTINCT CASE WHEN dim <= 304 THEN dim END) FROM testday GROUP BY test_id""",
    ),
)
def missing(spark, sf_dir):
    daily = ds.daily(spark, sf_dir).select(
        F.lit("daily").alias("kind"), F.col("user_id").alias("id"), ar.missing_days(F.col("milk")).alias("missing")
    )
    # the distinct days come from a partial aggregation, not from one array per lactation
    days = F.count_distinct(F.when(F.col("dim") <= ar.HORIZON, F.col("dim")))
    periodic = (
        ds.testday(spark, sf_dir).groupBy("test_id").agg((F.lit(ar.HORIZON) - days).alias("missing"))
        .select(F.lit("periodic").alias("kind"), F.col("test_id").alias("id"), F.col("missing").cast("int"))
    )
    return daily.unionByName(periodic)


@query("observed_days", ds.with_views("daily", "SELECT user_id, day AS dim, value AS milk FROM daily WHERE value IS NOT NULL"))
def observed(spark, sf_dir):
    return ds.daily(spark, sf_dir).select("user_id", F.inline(ar.observed_days(F.col("milk"))))


VEC = dict(
    s="""SELECT vec_id, pos, v, avg(v) OVER w AS m, stddev_pop(v) OVER w AS sd, min(v) OVER w AS lo, max(v) OVER w AS hi,
                max(abs(v)) OVER w AS top FROM vecrow WINDOW w AS (PARTITION BY vec_id)"""
)


def _vector(name: str, value, sql: str) -> None:
    @query(name, ds.with_views("vecrow", f"SELECT vec_id, pos AS day, round({sql}, 6) AS value FROM s", **VEC))
    def run(spark, sf_dir):
        return _rows(ds.vectors(spark, sf_dir), value(F.col("x")), key="vec_id")


_vector("seq_zscore", ar.zscore, "(v - m) / sd")
_vector("seq_minmax", ar.minmax, "(v - lo) / (hi - lo)")
_vector("seq_maxabs", ar.maxabs, "v / top")
_vector("seq_scale", lambda x: ar.scale(x, 80), "v / 80")
_vector("milk_scale", lambda x: ar.actual_milk(ar.milk_scale(x)), "v / 80 * 80")
_vector("herd_stats_norm_minmax", ar.stats_minmax, "(v - lo) / (hi - lo + 0.000001)")
_vector("herd_stats_norm", ar.stats_zscore, "(v - m) / (sd + 0.000001)")


@query(
    "pad_truncate",
    ds.with_views(
        "vecrow",
        """SELECT i.vec_id, 'post70' AS kind, p.p AS day, coalesce(r.v, -1) AS value
           FROM ids i CROSS JOIN slots p LEFT JOIN vecrow r ON r.vec_id = i.vec_id AND r.pos = p.p
           UNION ALL SELECT i.vec_id, 'pre70', p.p, coalesce(r.v, -1)
           FROM ids i CROSS JOIN slots p LEFT JOIN vecrow r ON r.vec_id = i.vec_id AND r.pos = p.p - 6
           UNION ALL SELECT vec_id, 'cut10', pos, v FROM vecrow WHERE pos <= 10""",
        slots="SELECT CAST(unnest(range(1, 71)) AS INTEGER) AS p",
        ids="SELECT DISTINCT vec_id FROM vecrow",
    ),
)
def pad(spark, sf_dir):
    x, filler = F.col("x"), F.lit(-1.0)
    kinds = {
        "post70": ar.pad_truncate(x, 70, filler),
        "pre70": ar.pad_truncate(x, 70, filler, mode="pre"),
        "cut10": ar.pad_truncate(x, 10, filler),
    }
    out = None
    for kind, value in kinds.items():
        part = ds.vectors(spark, sf_dir).select("vec_id", F.lit(kind).alias("kind"), F.posexplode(value).alias("p", "value"))
        part = part.select("vec_id", "kind", (F.col("p") + 1).alias("day"), "value")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "sliding_windows",
    ds.with_views(
        "vecrow",
        """SELECT vec_id, CAST(s AS INTEGER) AS start, count(*) AS n, round(sum((pos - s + 1) * v), 6) AS weighted
           FROM vecrow CROSS JOIN (SELECT unnest(range(1, 56, 5)) AS s) WHERE pos BETWEEN s AND s + 9 GROUP BY 1, 2""",
    ),
)
def windows(spark, sf_dir):
    rows = ds.vectors(spark, sf_dir).select("vec_id", F.inline(ar.windows(F.col("x"), 10, 5)))
    weighted = ar.total(F.transform("values", lambda v, i: v * (i + 1)))
    return rows.select("vec_id", "start", F.size("values").cast("bigint").alias("n"), F.round(weighted, 6).alias("weighted"))


def _nested(spark, sf_dir):
    return al.nest_lactation(ds.testday(spark, sf_dir))


def _last_of_day(spark, sf_dir):
    return al.last_of_day(ds.testday(spark, sf_dir))


PROJECT = "SELECT test_id, dim, arg_max(milk_kg, pos) AS y FROM testday WHERE dim <= 304 GROUP BY 1, 2"


@query(
    "project_daily",
    ds.with_views(
        "testday",
        """SELECT test_id, 304 AS slots, coalesce(n, 0) AS filled, coalesce(total, 0) AS total, coalesce(weighted, 0) AS weighted
           FROM (SELECT DISTINCT test_id FROM testday) LEFT JOIN
             (SELECT test_id, CAST(count(*) AS INTEGER) AS n, sum(y) AS total, sum(dim * y) AS weighted FROM p GROUP BY 1) USING (test_id)""",
        p=PROJECT,
    ),
)
def project(spark, sf_dir):
    projected = _last_of_day(spark, sf_dir).select("test_id", ar.project_daily(F.col("dim"), F.col("milk_kg")).alias("milk"))
    tallied = projected.select("test_id", F.size("milk").alias("slots"), daily.tally(F.col("milk")).alias("t"))
    return tallied.select(
        "test_id", "slots", F.col("t.positive").cast("int").alias("filled"), F.col("t.total").alias("total"), F.col("t.weighted").alias("weighted")
    )


@query(
    "periodic_horizon",
    ds.with_views(
        "testday",
        """SELECT test_id, CASE WHEN bool_or(milk_kg < 3) THEN 'invalid_milk' WHEN count(*) FILTER (WHERE dim <= 304) = 0 THEN 'no_day_in_horizon'
                    WHEN count(DISTINCT dim) FILTER (WHERE dim <= 304) < count(*) FILTER (WHERE dim <= 304) THEN 'duplicate_day' END AS reason,
                  CAST(count(*) FILTER (WHERE dim <= 304) AS INTEGER) AS usable
           FROM testday GROUP BY 1""",
    ),
)
def horizon(spark, sf_dir):
    dim = F.col("dim")
    # yields below 3 kg are made negative so that every reason occurs
    milk = F.transform("milk_kg", lambda v: F.when(v < 3, -v).otherwise(v))
    return _nested(spark, sf_dir).select(
        "test_id", ar.horizon_reject(dim, milk).alias("reason"), F.size(ar.in_horizon(dim, milk)).alias("usable")
    )


@query(
    "default_events",
    """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 304 ELSE 1 END AS n, CASE WHEN event_id % 5 = 0 THEN 'calving' ELSE event_type END AS first_event,
              CASE WHEN event_id % 5 = 0 THEN 'pad' ELSE event_type END AS last_event FROM events""",
)
def events(spark, sf_dir):
    given = F.when(F.col("event_id") % 5 != 0, F.array("event_type"))
    rows = ds.table(spark, sf_dir, "events").select("event_id", ar.default_events(given).alias("e"))
    return rows.select(
        "event_id", F.size("e").alias("n"), F.element_at("e", 1).alias("first_event"), F.element_at("e", -1).alias("last_event")
    )


SAMPLE = 1000


@query(
    "stratified_sample",
    ds.with_views(
        "cow",
        f"""SELECT test_id, parity FROM (SELECT *, rk <= greatest(1, round_even({SAMPLE}::DOUBLE * size / total, 0)) AS chosen FROM r)
            ORDER BY chosen DESC, md5(test_id || ':43'), test_id LIMIT {SAMPLE}""",
        r="""SELECT test_id, parity, row_number() OVER (PARTITION BY parity ORDER BY md5(test_id || ':42'), test_id) AS rk,
                    count(*) OVER (PARTITION BY parity) AS size, count(*) OVER () AS total FROM cow""",
    ),
)
def sample(spark, sf_dir):
    return sampling.stratified_sample(ds.cow(spark, sf_dir).select("test_id", "parity"), SAMPLE)


@query(
    "shuffle_batches",
    ds.with_views(
        "cow",
        """SELECT test_id, (rk - 1) // 32 AS batch_id, CAST((rk - 1) % 32 AS INTEGER) AS slot
           FROM (SELECT test_id, row_number() OVER (ORDER BY md5(test_id || ':42'), test_id) AS rk FROM cow)""",
    ),
)
def batches(spark, sf_dir):
    return sampling.shuffle_batches(ds.cow(spark, sf_dir).select("test_id"))


@query(
    "collate_batches",
    ds.with_views(
        "cow",
        """SELECT (rk - 1) // 32 AS batch_id, CAST(count(*) AS INTEGER) AS n, sum(((rk - 1) % 32 + 1) * test_id)::BIGINT AS weighted
           FROM (SELECT test_id, row_number() OVER (ORDER BY md5(test_id || ':42'), test_id) AS rk FROM cow) GROUP BY 1""",
    ),
)
def collated(spark, sf_dir):
    rows = sampling.collate(sampling.shuffle_batches(ds.cow(spark, sf_dir).select("test_id")))
    weighted = F.aggregate(
        F.transform("test_id", lambda v, i: v * (i + 1)), F.lit(0).cast("bigint"), lambda acc, v: acc + v
    )
    return rows.select("batch_id", F.size("test_id").alias("n"), weighted.alias("weighted"))


def _records(spark, sf_dir):
    """Documents of the shape a model reads: animal_id, herd_id, parity, milk, events, herd_stats."""
    daily = ds.daily(spark, sf_dir).withColumnRenamed("user_id", "animal_id")
    first = ds.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("animal_id")).agg(
        F.min_by("event_type", "event_id").alias("first_event")
    )
    return daily.join(first, "animal_id").select(
        "animal_id",
        (F.col("animal_id") % 25).alias("herd_id"),
        (1 + F.col("animal_id") % 5).cast("int").alias("parity"),
        "milk",
        F.array("first_event").alias("events"),
        F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: (F.col("animal_id") * i % 7).cast("double")).alias("herd_stats"),
    )


CHAIN = [
    {"name": "event_tokenization", "dictionary": EVENT_INDEX},
    {"name": "imputation", "method": "forward_fill"},
    {"name": "milk_normalization"},
    {"name": "herd_stats_normalization", "method": "minmax"},
]
CHAIN_SQL = dict(
    w=WINDOWED,
    m="""SELECT user_id AS animal_id, round(sum(coalesce(lv, 0) / 80), 5) AS milk_sum, round(sum(day * coalesce(lv, 0) / 80), 4) AS milk_weighted
         FROM w GROUP BY 1""",
    e="""SELECT user_id AS animal_id, CASE arg_min(event_type, event_id) WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END AS token
         FROM events GROUP BY 1""",
    h="""SELECT animal_id, CASE WHEN max(x) - min(x) > 0.000001 THEN round(sum((x - lo) / (hi - lo + 0.000001)), 5) ELSE round(sum(x), 5) END AS stats_sum
         FROM (SELECT animal_id, animal_id * i % 7 AS x, min(animal_id * i % 7) OVER w AS lo, max(animal_id * i % 7) OVER w AS hi
               FROM m CROSS JOIN (SELECT unnest(range(1, 11)) AS i) WINDOW w AS (PARTITION BY animal_id)) GROUP BY 1""",
)


@query(
    "transform_chain",
    ds.with_views(
        "daily", "SELECT animal_id, milk_sum, milk_weighted, token, stats_sum FROM m JOIN e USING (animal_id) JOIN h USING (animal_id)", **CHAIN_SQL
    ),
)
def chain(spark, sf_dir):
    out = ft.transform_chain(_records(spark, sf_dir), CHAIN)
    return out.select(
        "animal_id",
        F.round(ar.total(F.col("milk")), 5).alias("milk_sum"),
        F.round(ar.total(F.transform("milk", lambda v, i: v * (i + 1))), 4).alias("milk_weighted"),
        F.element_at("events", 1).alias("token"),
        F.round(ar.total(F.col("herd_stats")), 5).alias("stats_sum"),
    )


@query(
    "feature_rows",
    ds.with_views(
        "daily",
        """SELECT animal_id, 304 AS milk_n, 304 AS events_n, 10 AS stats_n, milk_sum, token, CAST(1 + animal_id % 5 AS DOUBLE) AS parity,
                  animal_id % 25 AS herd_id
           FROM (SELECT animal_id, round(milk_sum, 3) AS milk_sum FROM m) JOIN e USING (animal_id)""",
        **{**CHAIN_SQL, "m": CHAIN_SQL["m"].replace("sum(coalesce(lv, 0) / 80), 5", "sum(coalesce(lv, 0) / 80), 3")},
    ),
)
def feature(spark, sf_dir):
    out = ft.feature_rows(ft.transform_chain(_records(spark, sf_dir), CHAIN))
    f = F.col("features")
    return out.select(
        F.col("metadata.animal_id").alias("animal_id"),
        F.size(f["milk"]).alias("milk_n"),
        F.size(f["events"]).alias("events_n"),
        F.size(f["herd_stats"]).alias("stats_n"),
        F.round(ar.total(F.col("label").cast("array<double>")), 3).alias("milk_sum"),
        f["events"][0].alias("token"),
        f["parity"][0].cast("double").alias("parity"),
        F.col("metadata.herd_id").alias("herd_id"),
    )


CURVE_304 = [20 + 20 * (d / 60) if d <= 60 else 40 - 20 * (d - 60) / 244 for d in range(1, 305)]


SCORED = dict(
    p=PROJECT,
    curve="""SELECT CAST(d AS INTEGER) AS day, CASE WHEN d <= 60 THEN 20 + 20 * (d::DOUBLE / 60) ELSE 40 - 20 * (d::DOUBLE - 60) / 244 END AS c
             FROM (SELECT unnest(range(1, 305)) AS d)""",
    filled="""SELECT test_id, day, c, coalesce(CASE WHEN test_id % 2 = 0 THEN y ELSE last_value(y IGNORE NULLS) OVER
                     (PARTITION BY test_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END, 0) AS y
              FROM (SELECT DISTINCT test_id FROM testday) CROSS JOIN curve LEFT JOIN (SELECT test_id, dim AS day, y FROM p) USING (test_id, day)""",
    scale="""SELECT test_id, CASE WHEN sum(CASE WHEN y > 0 THEN c END) > 0 THEN sum(y) / sum(CASE WHEN y > 0 THEN c END) ELSE 1 END AS s
             FROM filled GROUP BY 1""",
)


def _daily_to_score(spark, sf_dir):
    return _last_of_day(spark, sf_dir).select(
        "test_id",
        ar.project_daily(F.col("dim"), F.col("milk_kg"), missing=None).alias("milk"),
        F.when(F.col("test_id") % 2 == 0, "zero").alias("imputation_method"),
    )


@query(
    "score_batch",
    ds.with_views("testday", "SELECT test_id, round(s * (SELECT sum(c) FROM curve), 6) AS total_kg FROM scale", **SCORED),
)
def score(spark, sf_dir):
    out = ft.score_batch(_daily_to_score(spark, sf_dir), ft.scaled_mean_curve(CURVE_304))
    return out.select("test_id", F.round("total_kg", 6).alias("total_kg"))


@query(
    "score_batch_shape",
    ds.with_views(
        "testday",
        """SELECT test_id, round(s * 40, 6) AS peak_yield, CASE WHEN s > 0 THEN 60 ELSE 1 END AS time_to_peak, round(s * (SELECT sum(c) FROM curve), 6) AS cumulative_yield,
                  round(CASE WHEN s > 0 THEN (SELECT c FROM curve WHERE day = 200) / 40 ELSE 0 END, 6) AS persistency FROM scale""",
        **SCORED,
    ),
)
def score_shape(spark, sf_dir):
    """The richest level of output; the scorer is set up inside each task."""
    out = ft.score_batch(_daily_to_score(spark, sf_dir), setup=partial(ft.scaled_mean_curve, CURVE_304), level="rich")
    digits = {"peak_yield": 6, "cumulative_yield": 6, "persistency": 6}
    rounded = [F.round(F.col(f"shape.{c}") + 0.0, n).alias(c) for c, n in digits.items()]
    return out.select("test_id", F.col("shape.time_to_peak").cast("int").alias("time_to_peak"), *rounded)
