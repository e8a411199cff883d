"""Curve fits as Spark jobs: one nested row per lactation, then a narrow map.

Records are reduced to one weighted day each before they are brought together, so a lactation
arrives with no more entries than days. Lactations with fewer distinct days than parameters get null
parameters and the reason ``too_few_days``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from dairyframe.functions import bounded_fit as bf, curves
from dairyframe.functions.curves import PARAMETERS, Params

# Parameter bounds of each fit, search ranges first, then the linear parameters.
BOUNDS = {
    "wood": bf.Bounds(search=((0.01, 1.5), (0.0001, 0.1)), linear=((1.0, 100.0),)),
    "fischer": bf.Bounds(search=((0.0001, 1.0),), linear=((0.0, 100.0), (0.0, 1.0))),
    "milkbot": bf.Bounds(search=((1.0, 100.0), (0.0001, 0.1)), linear=((1.0, 100.0), (-600.0, 300.0))),
    # a is bounded by multiples of the lactation's highest yield here
    "milkbot_trf": bf.Bounds(search=((1.0, 400.0), (0.000001, 1.0)), linear=((0.5, 8.0), (-300.0, 300.0))),
}
SOLVERS = {"wood": bf.wood, "fischer": bf.fischer, "milkbot": bf.milkbot, "milkbot_trf": bf.milkbot}
FITTED = {
    "wood": "abc",
    "fischer": "abc",
    "milkbot": "abcd",
    "milkbot_trf": "abcd",
    "wilmink": "abck",
    "ali_schaeffer": "abcdk",
}
FREE_PARAMETERS = {"wood": 3, "fischer": 3, "milkbot": 4, "milkbot_trf": 4, "wilmink": 3, "ali_schaeffer": 5}
TOO_FEW = "too_few_days"


def weighted_days(df: DataFrame, *, keys: Sequence[str] = ("test_id",)) -> DataFrame:
    """One row per key and day: keys, dim, w (records), y (mean yield), top; finite values only."""
    milk = F.col("milk_kg")
    usable = df.filter(F.col("dim").isNotNull() & milk.isNotNull() & ~F.isnan(milk) & (F.abs(milk) < float("inf")))
    return usable.groupBy(*keys, "dim").agg(
        F.count(F.lit(1)).cast("double").alias("w"), F.avg("milk_kg").alias("y"), F.max("milk_kg").alias("top")
    )


def nested_days(days: DataFrame, *, keys: Sequence[str] = ("test_id",)) -> DataFrame:
    """Weighted days to one row per key: parallel arrays t, w, y ordered by day, max_dim, top."""
    packed = F.array_sort(F.collect_list(F.struct(F.col("dim").cast("double").alias("t"), "w", "y")))
    rows = days.groupBy(*keys).agg(packed.alias("_d"), F.max("dim").alias("max_dim"), F.max("top").alias("top"))
    return rows.select(*keys, "max_dim", "top", *[F.col(f"_d.{name}").alias(name) for name in ("t", "w", "y")])


def once(udf):
    """A task function the optimizer must not copy: a filter on a fitted parameter would otherwise be
    pushed below the fit and run it a second time."""
    return udf.asNondeterministic()


def _usable_from(model: str) -> float:
    """First day whose records a fit uses."""
    return {"wilmink": -np.inf, "ali_schaeffer": 1.0}.get(model, 0.0)


def _kernel(model: str, days: bf.Days, top: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parameters, residual sums and convergence of one model for the lactations of a batch."""
    if model in SOLVERS:
        offsets = np.append(days.starts, len(days.t))
        return bf.fit_flagged(SOLVERS[model], offsets, days.t, days.w, days.y, BOUNDS[model], top if model == "milkbot_trf" else None)
    share = days.t / curves.HORIZON
    if model == "ali_schaeffer":
        gap = np.log(curves.HORIZON / days.t)
        basis = np.column_stack([np.ones_like(share), share, share**2, gap, gap**2])
    else:
        basis = np.column_stack([np.ones_like(share), share, np.exp(curves.WILMINK_K * days.t)])
    beta, sse = bf.fit_basis(basis, days)
    if model == "wilmink":
        beta = np.column_stack([beta[:, 0], beta[:, 1] / curves.HORIZON, beta[:, 2], np.full(len(beta), curves.WILMINK_K)])
    return beta, sse, np.ones(len(sse), bool)


def _fitted(models: Sequence[str]):
    """An Arrow function of a nested row (t, w, y, top) that returns a struct per model: parameters, sse, days, converged.

    All models are fitted from the same arrays of a batch, so lactations are read and nested once however many models are asked for.
    """
    inner = {m: ", ".join(f"{p}: double" for p in [*FITTED[m], "sse"]) + ", days: int, converged: boolean" for m in models}
    schema = ", ".join(f"{m} struct<{fields}>" for m, fields in inner.items())

    def one(model: str, t: np.ndarray, w: np.ndarray, y: np.ndarray, lengths: np.ndarray, top: np.ndarray) -> pa.Array:
        row = np.repeat(np.arange(len(lengths)), lengths)
        keep = t >= _usable_from(model)
        days = np.bincount(row[keep], minlength=len(lengths))
        enough = days >= FREE_PARAMETERS[model]
        keep &= enough[row]
        names = FITTED[model]
        out, converged = np.full((len(lengths), len(names) + 1), np.nan), np.zeros(len(lengths), bool)
        if enough.any():
            starts = np.cumsum(days[enough]) - days[enough]
            part = bf.Days(t[keep], w[keep], y[keep], starts, np.repeat(np.arange(len(starts)), days[enough]))
            params, sse, done = _kernel(model, part, top[enough])
            out[enough], converged[enough] = np.column_stack([params, sse]), done
        columns = [pa.array(out[:, i], mask=~enough) for i in range(out.shape[1])]
        columns += [pa.array(days.astype(np.int32)), pa.array(converged, mask=~enough)]
        return pa.StructArray.from_arrays(columns, names=[*names, "sse", "days", "converged"])

    @F.arrow_udf(schema)
    def fit(t: pa.Array, w: pa.Array, y: pa.Array, top: pa.Array) -> pa.Array:
        lengths = np.asarray(t.value_lengths().fill_null(0))
        flat = [np.asarray(x.flatten(), dtype=float) for x in (t, w, y)]
        each = [one(m, *flat, lengths, np.asarray(top, dtype=float)) for m in models]
        return pa.StructArray.from_arrays(each, names=list(models))

    return once(fit)


def fit_nested(rows: DataFrame, models: Sequence[str], *, keys: Sequence[str] = ("test_id",)) -> DataFrame:
    """Nested rows to one row per key and fit: keys, fit, model, a, b, c, d, k, sse, days, max_dim, reason, converged.

    ``fit`` is the name asked for, ``model`` the curve it gives parameters of.
    """
    none = F.lit(None).cast("double")

    def entry(model: str) -> Column:
        fit = F.col(f"_fit.{model}")
        name = model.removesuffix("_trf")
        parameters = [(fit[p] if p in FITTED[model] else none).alias(p) for p in PARAMETERS]
        reason = F.when(fit["days"] < FREE_PARAMETERS[model], TOO_FEW).alias("reason")
        return F.struct(F.lit(model).alias("fit"), F.lit(name).alias("model"), *parameters, fit["sse"].alias("sse"), fit["days"].alias("days"), "max_dim", reason, fit["converged"].alias("converged"))

    fitted = rows.withColumn("_fit", _fitted(models)("t", "w", "y", "top"))
    return fitted.select(*keys, F.inline(F.array(*[entry(m) for m in models])))


def _fit_wilmink(days: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """Least squares of (1, t, exp(-0.05 t)) in closed form from nine weighted sums, all in columns.

    Days enter as t / 305 so that the normal equations stay well scaled.
    """
    days = days.withColumns(
        {"_s": F.col("dim") / float(curves.HORIZON), "_e": F.exp(curves.WILMINK_K * F.col("dim"))}
    )
    w, s, e, y = (F.col(c) for c in ("w", "_s", "_e", "y"))
    sums = days.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("days"),
        F.max("dim").alias("max_dim"),
        F.sum(w).alias("n"),
        F.sum(w * s).alias("s"),
        F.sum(w * e).alias("e"),
        F.sum(w * s * s).alias("ss"),
        F.sum(w * s * e).alias("se"),
        F.sum(w * e * e).alias("ee"),
        F.sum(w * y).alias("y"),
        F.sum(w * s * y).alias("sy"),
        F.sum(w * e * y).alias("ey"),
    )
    # Cofactors of the symmetric normal matrix [[n, s, e], [s, ss, se], [e, se, ee]].
    n, s, e, ss, se, ee = (F.col(c) for c in ("n", "s", "e", "ss", "se", "ee"))
    y, sy, ey = (F.col(c) for c in ("y", "sy", "ey"))
    cof = sums.withColumns(
        {
            "c11": ss * ee - se * se,
            "c12": se * e - s * ee,
            "c13": s * se - ss * e,
            "c22": n * ee - e * e,
            "c23": s * e - n * se,
            "c33": n * ss - s * s,
        }
    )
    det = n * F.col("c11") + s * F.col("c12") + e * F.col("c13")
    solvable = (F.col("days") >= 3) & (det != 0)
    solved = cof.select(
        *keys,
        "days",
        "max_dim",
        F.when(solvable, (F.col("c11") * y + F.col("c12") * sy + F.col("c13") * ey) / det).alias("a"),
        F.when(
            solvable, (F.col("c12") * y + F.col("c22") * sy + F.col("c23") * ey) / det / float(curves.HORIZON)
        ).alias("b"),
        F.when(solvable, (F.col("c13") * y + F.col("c23") * sy + F.col("c33") * ey) / det).alias("c"),
        F.when(~solvable, TOO_FEW).alias("reason"),
    )
    none = F.lit(None).cast("double")
    return solved.select(
        *keys,
        F.lit("wilmink").alias("model"),
        "a",
        "b",
        "c",
        none.alias("d"),
        F.when(F.col("a").isNotNull(), F.lit(curves.WILMINK_K)).alias("k"),
        "days",
        "max_dim",
        "reason",
    )


def fit_days(days: DataFrame, model: str, *, keys: Sequence[str] = ("test_id",)) -> DataFrame:
    """Fit weighted days: keys, model, a, b, c, d, k, days, max_dim, reason, converged."""
    if model not in FITTED:
        raise ValueError(f"no fit for model {model!r}; fitted models: {', '.join(FITTED)}")
    if model == "wilmink":
        return _fit_wilmink(days, keys=keys).withColumn("converged", F.when(F.col("reason").isNull(), True))
    return fit_nested(nested_days(days.filter(F.col("dim") >= _usable_from(model)), keys=keys), [model], keys=keys).drop("sse", "fit")


def fit_curve(df: DataFrame, model: str, *, keys: Sequence[str] = ("test_id",)) -> DataFrame:
    """Fit one curve per lactation of a test-day table."""
    return fit_days(weighted_days(df, keys=keys), model, keys=keys)


def fit_population_curve(df: DataFrame, model: str = "wood") -> DataFrame:
    """One curve for a whole population: a single row of parameters with test_id 0.

    The records shrink to one weighted day each (at most one row per day of lactation) before the
    single fit, so nothing large meets in one task.
    """
    days = weighted_days(df, keys=()).withColumn("test_id", F.lit(0))
    return fit_days(days, model)


def predict_curve(params: DataFrame, *, min_days: int = curves.HORIZON) -> DataFrame:
    """Daily yields for days 1..max(305, max_dim) of every parameter row: key columns, day, milk_kg."""
    longest = F.greatest(F.lit(min_days), F.col("max_dim")) if "max_dim" in params.columns else F.lit(min_days)
    keys = [c for c in params.columns if c not in (*PARAMETERS, "max_dim", "days", "reason", "sse", "converged")]
    fitted = F.col("reason").isNull() if "reason" in params.columns else F.col("a").isNotNull()
    long = params.filter(fitted).select(
        *keys, *PARAMETERS, F.explode(F.sequence(F.lit(1), longest.cast("int"))).alias("day")
    )
    return long.select(*keys, "day", curves.curve_by_name(F.col("model"), F.col("day"), Params.of()).alias("milk_kg"))


def fit_residuals(df: DataFrame, params: DataFrame, *, keys: Sequence[str] = ("test_id",)) -> DataFrame:
    """Squared-error sum of given parameters per lactation: keys, n, sse.

    Records meet their parameters per (lactation, day) after the day aggregation; the spread inside a
    day is carried along, so the sum equals the record-level one.
    """
    milk = F.col("milk_kg")
    days = df.groupBy(*keys, "dim").agg(
        F.count(milk).alias("n"), F.avg(milk).alias("y"), F.coalesce(F.var_pop(milk), F.lit(0.0)).alias("v")
    )
    joined = days.join(params.select(*keys, "model", *PARAMETERS), list(keys))
    gap = F.col("y") - curves.curve_by_name(F.col("model"), F.col("dim"), Params.of())
    return joined.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("v") + gap * gap)).alias("sse")
    )
