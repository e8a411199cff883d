"""Characteristics of parameterised curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from dairyframe import datasets as ds
from dairyframe.operators import characteristics as ch, fitting
from dairyframe.plans import query
from dairyframe.plans.models import DAILY_SQL, SQL_FORMS, customer_params, customer_params_sql

PEAK_SQL = """CASE model WHEN 'wood' THEN b / c WHEN 'milkbot' THEN c - b * ln(2 * b * d / (1 + b * d))
                   WHEN 'fischer' THEN ln(a * c / b) / c WHEN 'wilmink' THEN ln(-b / (c * k)) / k END"""
AT_PEAK_SQL = "CASE model " + " ".join(
    f"WHEN '{m}' THEN {SQL_FORMS[m]}" for m in ("wood", "milkbot", "fischer", "wilmink")
) + " END"


def total_sql(T: str) -> str:
    return f"""CASE model
      WHEN 'wilmink' THEN a*{T} + b*{T}*{T}/2 + c/k*(exp(k*{T}) - 1)
      WHEN 'fischer' THEN a*{T} - b*{T}*{T}/2 - a/c*(1 - exp(-c*{T}))
      WHEN 'milkbot' THEN a*((1 - exp(-d*{T}))/d - exp(c/b)/2*(1 - exp(-(d + 1/b)*{T}))/(d + 1/b))
      WHEN 'ali_schaeffer' THEN a*{T} + b*{T}*{T}/610 + c*{T}*{T}*{T}/(3*305*305.0) + d*{T}*(ln(305/{T}) + 1)
           + k*{T}*(ln(305/{T})*ln(305/{T}) + 2*ln(305/{T}) + 2)
      WHEN 'wood' THEN a*pow(c, -(b + 1)) * list_sum(list_transform(range(0, 401),
           lambda i: exp((b + 1 + i)*ln(c*{T}) - c*{T} + lgamma(b + 1) - lgamma(b + 2 + i)))) END"""


def sql(end: str) -> str:
    return f"""WITH p AS ({customer_params_sql()}), d AS ({DAILY_SQL}),
        g AS (SELECT curve_id, max(y) AS top FROM d GROUP BY 1),
        h AS (SELECT curve_id, top, min(CASE WHEN y = top THEN day END) AS day,
                     sum(CASE WHEN day <= {end} THEN y END) - max(CASE WHEN day = 1 THEN y END) / 2
                       - max(CASE WHEN day = {end} THEN y END) / 2 AS trap,
                     max(CASE WHEN day = {end} THEN y END) AS y_end
              FROM d JOIN g USING (curve_id) GROUP BY 1, 2),
        t AS (SELECT p.*, h.top, h.day, h.trap, h.y_end, CAST({end} AS DOUBLE) AS L, {PEAK_SQL} AS t FROM p JOIN h USING (curve_id))
        SELECT curve_id, model, round(coalesce(CASE WHEN t > 0 THEN t END, day), 4) AS time_to_peak,
               round(coalesce(CASE WHEN t > 0 THEN {AT_PEAK_SQL} END, top), 4) AS peak_yield,
               round(coalesce({total_sql("L")}, trap), 3) AS cumulative_milk_yield,
               round(CASE WHEN L <> day THEN (y_end - top) / (L - day) END, 6) AS persistency FROM t"""


def _rounded(df):
    digits = {"time_to_peak": 4, "peak_yield": 4, "cumulative_milk_yield": 3, "persistency": 6}
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


@query("characteristics_from_params", sql("305"))
def from_params(spark, sf_dir):
    return _rounded(ch.characteristics_from_params(customer_params(spark, sf_dir)))


def _one(column: str, end: str, length):
    def run(spark, sf_dir):
        out = _rounded(ch.characteristics_from_params(customer_params(spark, sf_dir), length=length))
        return out.select("curve_id", "model", column)

    return run, f"SELECT curve_id, model, {column} FROM ({sql(end)})"


for _name, _column, _end, _length in (
    ("time_to_peak", "time_to_peak", "305", 305),
    ("peak_yield", "peak_yield", "305", 305),
    ("cumulative_yield", "cumulative_milk_yield", "250", 250),
    ("persistency_derived", "persistency", "max_dim", "max"),
):
    _run, _sql = _one(_column, _end.replace("max_dim", "max_dim"), _length)
    query(_name, _sql)(_run)


@query("persistency_wood", f"WITH p AS ({customer_params_sql()}) SELECT curve_id, round(-(b + 1) * ln(c), 6) AS persistency FROM p WHERE model = 'wood'")
def wood(spark, sf_dir):
    params = customer_params(spark, sf_dir).filter("model = 'wood'")
    out = ch.characteristics_from_params(params, persistency="literature")
    return out.select("curve_id", F.round("persistency", 6).alias("persistency"))


@query("persistency_milkbot", f"WITH p AS ({customer_params_sql()}) SELECT curve_id, round(0.693 / d, 6) AS persistency FROM p WHERE model = 'milkbot'")
def milkbot(spark, sf_dir):
    params = customer_params(spark, sf_dir).filter("model = 'milkbot'")
    out = ch.characteristics_from_params(params, persistency="literature")
    return out.select("curve_id", F.round("persistency", 6).alias("persistency"))


@query("characteristics_batch")
def batch(spark, sf_dir):
    """All six fits of the measured yields from one nested row. Each fit has its own SQL; what follows from parameters is checked by
    ``characteristics_from_params``, and the whole against brute force on a fixture."""
    return _rounded(ch.characteristics_batch(ds.testday(spark, sf_dir), list(fitting.FITTED)))
