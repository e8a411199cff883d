"""Peak, total and persistency of parameterised curves.

In: a parameter table (any key columns, ``model``, ``a, b, c, d, k``, optionally ``max_dim``). Closed
forms are used where they exist. The daily curve is walked once per row inside a task and gives the peak and
the area where a closed form is missing or unusable; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from dairyframe.functions import curves, daily
from dairyframe.functions.curves import PARAMETERS, Params
from dairyframe.operators import fitting

CLOSED_PEAK = ("wood", "milkbot", "fischer", "wilmink")
CLOSED_TOTAL = ("wood", "wilmink", "fischer", "milkbot", "ali_schaeffer")
CHARACTERISTICS = ("time_to_peak", "peak_yield", "cumulative_milk_yield", "persistency")


def _by_model(known: Sequence[str], value: Callable[[str], Column], present: Sequence[str] | None) -> Column:
    models = [m for m in known if present is None or m in present]
    if not models:
        return F.lit(None).cast("double")
    picked = F.when(F.col("model") == models[0], value(models[0]))
    for name in models[1:]:
        picked = picked.when(F.col("model") == name, value(name))
    return picked


def _usable(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def _non_negative(c: Column) -> Column:
    return F.when(c >= 0, c)


def _daily(models: Sequence[str] | None, prefix: str = "") -> Column:
    """Yields of days 1.._horizon as an array; the model is chosen once per row."""
    parameters = [F.col(f"{prefix}{name}") for name in PARAMETERS]
    return daily.daily_curve(F.col(f"{prefix}model"), parameters, F.col(f"{prefix}_horizon"), models or list(curves.MODELS))


def characteristics_from_params(
    params: DataFrame,
    *,
    length: int | str = curves.HORIZON,
    persistency: str = "derived",
    models: Sequence[str] | None = None,
) -> DataFrame:
    """Key columns, model, time_to_peak, peak_yield, cumulative_milk_yield, persistency.

    ``length`` is the horizon of the total and the end of the persistency slope: a number of days, or
    'max' for each lactation's own last day. Negative values become null, except persistency, which is
    null only when the end day is the peak day. ``persistency='literature'`` uses the published
    formulas and needs wood or milkbot rows. ``models`` names the models that occur, which keeps the
    expressions short.
    """
    fitting_options = ("derived", "literature")
    if persistency not in fitting_options:
        raise ValueError(f"persistency must be one of {', '.join(fitting_options)}")
    if isinstance(length, str) and length.lower() != "max":
        raise ValueError("length must be a number of days or 'max'")
    keys = [c for c in params.columns if c not in (*PARAMETERS, "model", "max_dim", "days", "reason", "sse", "converged")]
    last = F.col("max_dim") if "max_dim" in params.columns else F.lit(curves.HORIZON)
    end = last.cast("int") if isinstance(length, str) else F.lit(int(length))
    horizon = F.greatest(F.lit(curves.HORIZON), last.cast("int"), end)
    p = Params.of()
    known = F.col("reason").isNull() if "reason" in params.columns else F.col("a").isNotNull()
    base = params.filter(known).select(
        *keys, "model", *[F.col(n).cast("double").alias(n) for n in PARAMETERS], end.alias("_end"), horizon.alias("_horizon")
    )
    base = daily.walk_curves(base, models or list(curves.MODELS))

    closed_day = _usable(_by_model(CLOSED_PEAK, lambda m: curves.peak_day_closed(m, p), models))
    base = base.withColumn("_peak", F.when(closed_day > 0, closed_day))
    at_peak = _usable(_by_model(CLOSED_PEAK, lambda m: curves.curve(m, F.col("_peak"), p), models))
    total = _usable(_by_model(CLOSED_TOTAL, lambda m: curves.integral_closed(m, F.col("_end"), p, gamma=F.col("_gamma")), models))
    if persistency == "literature":
        lasting = F.when(F.col("model") == "wood", curves.persistency_wood(p.b, p.c)).when(
            F.col("model") == "milkbot", curves.persistency_milkbot(p.d)
        )
    else:
        run = F.col("_end") - F.col("_day")
        lasting = F.when(run != 0, (F.col("_last") - F.col("_top")) / run)
    return base.select(
        *keys,
        "model",
        F.coalesce("_peak", F.col("_day").cast("double")).alias("time_to_peak"),
        _non_negative(F.coalesce(at_peak, _usable(F.col("_top")))).alias("peak_yield"),
        _non_negative(F.coalesce(total, _usable(F.col("_trapezoid")))).alias("cumulative_milk_yield"),
        lasting.alias("persistency"),
    )


def calculate_characteristics(
    df: DataFrame, model: str, *, length: int | str = curves.HORIZON, persistency: str = "derived"
) -> DataFrame:
    """Fit one model per lactation of a test-day table and derive its characteristics."""
    fit = fitting.fit_curve(df, model)
    return characteristics_from_params(fit, length=length, persistency=persistency, models=[model.removesuffix("_trf")])


def characteristics_batch(
    df: DataFrame, models: Sequence[str], *, length: int | str = curves.HORIZON, persistency: str = "derived"
) -> DataFrame:
    """Several fits for many lactations, keyed by id and ``fit``.

    Records are reduced to days and nested once; one task function fits all models from the nested row, so the
    input is read once and shuffled twice (days, lactations) however many models there are.
    """
    fits = fitting.fit_nested(fitting.nested_days(fitting.weighted_days(df)), models)
    names = list(dict.fromkeys(m.removesuffix("_trf") for m in models))
    return characteristics_from_params(fits, length=length, persistency=persistency, models=names)


def _with_horizon(params: DataFrame, min_days: int) -> DataFrame:
    """The rows that have a curve, with ``_horizon``, its last day."""
    longest = F.greatest(F.lit(min_days), F.col("max_dim")) if "max_dim" in params.columns else F.lit(min_days)
    known = F.col("reason").isNull() if "reason" in params.columns else F.col("a").isNotNull()
    return params.filter(known).withColumn("_horizon", longest.cast("int"))


def daily_arrays(params: DataFrame, *, min_days: int = curves.HORIZON, models: Sequence[str] | None = None) -> DataFrame:
    """Daily yields of days 1..max(305, max_dim) of every parameter row as an array: key columns, y.

    The curve is built inside its row: nothing is laid out by day, and nothing is shuffled.
    """
    keys = [c for c in params.columns if c not in (*PARAMETERS, "model", "max_dim", "days", "reason", "sse", "converged")]
    return _with_horizon(params, min_days).select(*keys, _daily(models).alias("y"))


def array_diff(
    a: DataFrame, b: DataFrame, *, keys: Sequence[str] = ("test_id",), min_days: int = curves.HORIZON, models: Sequence[str] | None = None
) -> DataFrame:
    """Largest and mean absolute difference of two curves per key over the days that both have: keys, max_diff, mean_diff.

    Each side holds arrays (keys, y) or parameter rows (keys, model, a, b, c, d, k, optionally max_dim and reason). Parameter rows are
    joined before their curves are laid out, so no curve is shuffled. The join sorts and merges: a side may be small as files and
    large as arrays, and must not be gathered in the driver to be broadcast.
    """

    def side(df: DataFrame, prefix: str) -> DataFrame:
        carried = ["y"] if "y" in df.columns else ["model", *PARAMETERS, "_horizon"]
        rows = df if "y" in df.columns else _with_horizon(df, min_days)
        return rows.select(*keys, *[F.col(c).alias(f"{prefix}{c}") for c in carried]).hint("merge")

    joined = side(a, "_a_").join(side(b, "_b_"), list(keys))
    for prefix in ("_a_", "_b_"):
        if f"{prefix}y" not in joined.columns:
            joined = joined.withColumn(f"{prefix}y", _daily(models, prefix))
    compared = joined.select(*keys, daily.gap(F.col("_a_y"), F.col("_b_y")).alias("_g"))
    return compared.select(*keys, F.col("_g.top").alias("max_diff"), F.col("_g.mean").alias("mean_diff"))


def residuals_at(params: DataFrame, actual: DataFrame, *, keys: Sequence[str] = ("test_id",), models: Sequence[str] | None = None) -> DataFrame:
    """MAE and RMSE of fitted curves against actual daily yields per key: keys, n, mae, rmse.

    The parameters, one row per key, meet the measured days, and the curve is worked out on those days only. Days before 1 and
    beyond max(305, max_dim) have no predicted yield.
    """
    longest = F.greatest(F.lit(curves.HORIZON), F.col("max_dim")) if "max_dim" in params.columns else F.lit(curves.HORIZON)
    fitted = params.select(*keys, "model", *PARAMETERS, longest.alias("_last"))
    rows = actual.select(*keys, "day", F.col("milk_kg").alias("_actual")).join(fitted, list(keys))
    rows = rows.filter((F.col("day") >= 1) & (F.col("day") <= F.col("_last")))
    gap = F.col("_actual") - curves.curve_by_name(F.col("model"), F.col("day"), Params.of(), models)
    return rows.groupBy(*keys).agg(F.count(gap).alias("n"), F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"))


def curve_stats(values: Column) -> list[Column]:
    """mean, max, min, population std and total of a predicted curve array."""
    found = daily.summary(values)
    names = {"mean": "mean_milk", "top": "max_milk", "low": "min_milk", "std": "std_milk", "total": "total_milk"}
    return [found[field].alias(name) for field, name in names.items()]


def curve_shape_stats(values: Column, *, late_day: int = 200, cumulative: Column | None = None) -> list[Column]:
    """Peak, first day of peak, sum, and the ratio of the late day (or the last day) to the peak.

    ``cumulative`` is the sum where it is known already (null if a value is null).
    """
    top = F.array_max(values)
    late = F.coalesce(F.try_element_at(values, F.lit(late_day)), F.element_at(values, -1))
    return [
        top.alias("peak_yield"),
        F.array_position(values, top).alias("time_to_peak"),
        (daily.summary(values)["plain"] if cumulative is None else cumulative).alias("cumulative_yield"),
        F.when(top > 0, late / top).otherwise(F.lit(0.0)).alias("persistency"),
    ]


def residual_metrics(predicted: DataFrame, actual: DataFrame, *, keys: Sequence[str] = ("test_id",)) -> DataFrame:
    """MAE and RMSE of predicted against actual daily yields per key: keys, n, mae, rmse.

    Both sides hold a (key, day) at most once, so the join has no hot key.
    """
    gap = F.col("_actual") - F.col("_predicted")
    left = predicted.select(*keys, "day", F.col("milk_kg").alias("_predicted"))
    right = actual.select(*keys, "day", F.col("milk_kg").alias("_actual"))
    return (
        left.join(right, [*keys, "day"])
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"))
    )


def curve_diff(a: DataFrame, b: DataFrame, *, keys: Sequence[str] = ("test_id",)) -> DataFrame:
    """Largest and mean absolute difference of two curves per key, joined on (key, day)."""
    gap = F.abs(F.col("_a") - F.col("_b"))
    left = a.select(*keys, "day", F.col("milk_kg").alias("_a"))
    right = b.select(*keys, "day", F.col("milk_kg").alias("_b"))
    return (
        left.join(right, [*keys, "day"]).groupBy(*keys).agg(F.max(gap).alias("max_diff"), F.avg(gap).alias("mean_diff"))
    )
