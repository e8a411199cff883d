"""The fourteen curve models and daily predictions, over parameters spread by order and customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from dairyframe import datasets as ds
from dairyframe.functions import curves
from dairyframe.operators import characteristics as ch, fitting
from dairyframe.plans import query

# Base parameters (a, b, c, d, k) per model; each row scales ``a`` a little.
BASE: dict[str, tuple[float | None, ...]] = {
    "milkbot": (40.0, 30.0, 10.0, 0.005, None),
    "wood": (20.0, 0.2, 0.004, None, None),
    "wilmink": (32.0, -0.04, -12.0, None, -0.05),
    "ali_schaeffer": (25.0, 5.0, -2.0, 1.0, 0.5),
    "fischer": (30.0, 0.03, 0.08, None, None),
    "brody": (35.0, None, None, None, 0.002),
    "sikka": (22.0, 0.006, 0.00003, None, None),
    "nelder": (0.6, 0.02, 0.00008, None, None),
    "dhanoa": (15.0, 50.0, 0.005, None, None),
    "emmans": (38.0, 0.06, 0.002, 0.5, None),
    "hayashi": (0.1, 36.0, 240.0, 0.0, None),
    "rook": (42.0, 15.0, 4.0, 0.002, None),
    "dijkstra": (14.0, 0.06, 0.05, 0.0025, None),
    "prasad": (30.0, -0.03, 0.00001, 6.0, None),
}
SQL_FORMS = {
    "milkbot": "a*(1-exp((c-t)/b)/2)*exp(-d*t)",
    "wood": "a*pow(t,b)*exp(-c*t)",
    "wilmink": "a+b*t+c*exp(k*t)",
    "ali_schaeffer": "a+b*(t/305)+c*(t/305)*(t/305)+d*ln(305/t)+k*ln(305/t)*ln(305/t)",
    "fischer": "a-b*t-a*exp(-c*t)",
    "brody": "a*exp(-k*t)",
    "sikka": "a*exp(b*t-c*t*t)",
    "nelder": "t/(a+b*t+c*t*t)",
    "dhanoa": "a*pow(t,b*c)*exp(-c*t)",
    "emmans": "a*exp(-exp(d-b*t))*exp(-c*t)",
    "hayashi": "b*(exp(-t/c)-exp(-t/(a*c)))",
    "rook": "a*(1/(1+b/(c+t)))*exp(-d*t)",
    "dijkstra": "a*exp(b*(1-exp(-c*t))/c-d*t)",
    "prasad": "a+b*t+c*t*t+d/t",
}


def _literal(value: float | None) -> str:
    return "CAST(NULL AS DOUBLE)" if value is None else f"CAST('{value!r}' AS DOUBLE)"


def order_params_sql(model: str) -> str:
    a, *rest = BASE[model]
    cells = ", ".join(f"{_literal(v)} AS {n}" for v, n in zip(rest, "bcdk"))
    return f"""SELECT o_orderkey AS row_id, CAST(1 + o_orderkey % 330 AS DOUBLE) AS t,
                      {_literal(a)} * (1 + CAST(o_custkey % 10 AS DOUBLE) / 100) AS a, {cells} FROM orders"""


def order_params(spark, sf_dir, model: str):
    a, *rest = BASE[model]
    return ds.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        (1 + F.col("o_orderkey") % 330).cast("double").alias("t"),
        (F.lit(a) * (1 + (F.col("o_custkey") % 10).cast("double") / 100)).alias("a"),
        *[F.lit(v).cast("double").alias(n) for v, n in zip(rest, "bcdk")],
    )


def _register(model: str) -> None:
    sql = f"WITH p AS ({order_params_sql(model)}) SELECT row_id, round({SQL_FORMS[model]}, 6) + 0.0 AS milk_kg FROM p"

    @query(f"model_{model}", sql)
    def run(spark, sf_dir):
        params = order_params(spark, sf_dir, model)
        return params.select("row_id", (F.round(curves.curve(model, F.col("t")), 6) + 0.0).alias("milk_kg"))


for _name in BASE:
    _register(_name)


@query(
    "model_brody_two_term",
    """SELECT o_orderkey AS row_id,
              round(30 * exp(-0.002 * (1 + o_orderkey % 330)) - (5 + o_custkey % 10) * exp(-0.05 * (1 + o_orderkey % 330)), 6) AS milk_kg
       FROM orders""",
)
def two_term(spark, sf_dir):
    t = 1 + F.col("o_orderkey") % 330
    value = curves.brody_two_term(t, F.lit(30), 5 + F.col("o_custkey") % 10, F.lit(0.002), F.lit(0.05))
    return ds.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), F.round(value, 6).alias("milk_kg"))


# One parameter row per customer; the models take turns.
def customer_params_sql() -> str:
    names = list(BASE)

    def pick(slot: int, name: str) -> str:
        cases = " ".join(f"WHEN {i} THEN {_literal(BASE[m][slot])}" for i, m in enumerate(names))
        return f"CASE c_custkey % {len(names)} {cases} END AS {name}0"

    cells = ", ".join(pick(i, n) for i, n in enumerate("abcdk"))
    models = "(['" + "','".join(names) + f"'])[1 + c_custkey % {len(names)}]"
    return f"""SELECT curve_id, model, a0 * (1 + CAST(curve_id // 14 % 10 AS DOUBLE) / 100) AS a, b0 AS b, c0 AS c, d0 AS d, k0 AS k,
                      CAST(280 + curve_id % 60 AS INTEGER) AS max_dim
               FROM (SELECT c_custkey AS curve_id, {models} AS model, {cells} FROM customer)"""


def customer_params(spark, sf_dir):
    names = list(BASE)
    turn = (1 + F.col("c_custkey") % len(names)).cast("int")
    rows = F.array(
        *[
            F.struct(F.lit(m).alias("model"), *[F.lit(v).cast("double").alias(n) for v, n in zip(BASE[m], "abcdk")])
            for m in names
        ]
    )
    picked = ds.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("curve_id"), F.element_at(rows, turn).alias("p")
    )
    step = 1 + (F.floor(F.col("curve_id") / 14) % 10).cast("double") / 100
    return picked.select(
        "curve_id",
        "p.model",
        (F.col("p.a") * step).alias("a"),
        *[F.col(f"p.{n}").alias(n) for n in "bcdk"],
        (280 + F.col("curve_id") % 60).cast("int").alias("max_dim"),
    )


CURVE_CASE = "CASE model " + " ".join(f"WHEN '{m}' THEN {f}" for m, f in SQL_FORMS.items()) + " END"
DAILY_SQL = f"""
    SELECT curve_id, model, max_dim, t AS day, {CURVE_CASE} AS y
    FROM p CROSS JOIN (SELECT CAST(unnest(range(1, 340)) AS DOUBLE) AS t) WHERE t <= greatest(305, max_dim)"""


@query(
    "predict_curve",
    f"""WITH p AS ({customer_params_sql()}), d AS ({DAILY_SQL})
        SELECT curve_id, count(*) AS days, round(sum(y), 4) AS total_kg, round(sum(day * y), 2) AS day_weighted,
               round(max(CASE WHEN day = 305 THEN y END), 4) AS day_305_kg FROM d GROUP BY 1""",
)
def predict(spark, sf_dir):
    daily = fitting.predict_curve(customer_params(spark, sf_dir))
    return daily.groupBy("curve_id").agg(
        F.count(F.lit(1)).alias("days"),
        F.round(F.sum("milk_kg"), 4).alias("total_kg"),
        F.round(F.sum(F.col("day") * F.col("milk_kg")), 2).alias("day_weighted"),
        F.round(F.max(F.when(F.col("day") == 305, F.col("milk_kg"))), 4).alias("day_305_kg"),
    )


def _daily_arrays(spark, sf_dir):
    """Predicted curves as arrays: curve_id, y."""
    return ch.daily_arrays(customer_params(spark, sf_dir))


@query(
    "curve_stats",
    f"""WITH p AS ({customer_params_sql()}), d AS ({DAILY_SQL})
        SELECT curve_id, round(avg(y), 4) AS mean_milk, round(max(y), 4) AS max_milk, round(min(y), 4) AS min_milk,
               round(stddev_pop(y), 4) AS std_milk, round(sum(y), 4) AS total_milk FROM d GROUP BY 1""",
)
def stats(spark, sf_dir):
    out = _daily_arrays(spark, sf_dir).select("curve_id", *ch.curve_stats(F.col("y")))
    return out.select("curve_id", *[F.round(c, 4).alias(c) for c in out.columns[1:]])


@query(
    "curve_shape_stats",
    f"""WITH p AS ({customer_params_sql()}), d AS ({DAILY_SQL}), m AS (SELECT curve_id, max(y) AS top FROM d GROUP BY 1)
        SELECT curve_id, round(top, 4) AS peak_yield, CAST(min(CASE WHEN y = top THEN day END) AS BIGINT) AS time_to_peak,
               round(sum(y), 4) AS cumulative_yield, round(max(CASE WHEN day = 200 THEN y END) / top, 6) AS persistency
        FROM d JOIN m USING (curve_id) GROUP BY curve_id, top""",
)
def shape(spark, sf_dir):
    out = _daily_arrays(spark, sf_dir).select("curve_id", *ch.curve_shape_stats(F.col("y")))
    return out.select(
        "curve_id",
        F.round("peak_yield", 4).alias("peak_yield"),
        "time_to_peak",
        F.round("cumulative_yield", 4).alias("cumulative_yield"),
        F.round("persistency", 6).alias("persistency"),
    )


@query(
    "curve_diff",
    f"""WITH p AS ({customer_params_sql()}), d AS ({DAILY_SQL}),
        q AS (SELECT * REPLACE (a * 1.05 AS a) FROM p), e AS ({DAILY_SQL.replace("FROM p ", "FROM q ")})
        SELECT curve_id, round(max(abs(d.y - e.y)), 4) AS max_diff, round(avg(abs(d.y - e.y)), 4) AS mean_diff
        FROM d JOIN e USING (curve_id, day) GROUP BY 1""",
)
def diff(spark, sf_dir):
    params = customer_params(spark, sf_dir)
    shifted = params.withColumn("a", F.col("a") * 1.05)
    out = ch.array_diff(params, shifted, keys=["curve_id"])
    return out.select("curve_id", F.round("max_diff", 4).alias("max_diff"), F.round("mean_diff", 4).alias("mean_diff"))
