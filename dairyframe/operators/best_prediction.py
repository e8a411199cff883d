"""Best prediction: yields from the covariance of daily deviations, and the fit of that covariance."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from dairyframe.functions.daily import flat, spread_days
from dairyframe.operators.alignment import dedup_day
from dairyframe.operators.skew import join_lookup
from dairyframe.session import scratch_path

HORIZON = 305


def _expected(curve: Sequence[float] | DataFrame, day: Column) -> Column:
    curve = curve_values(curve)
    if len(curve) != HORIZON:
        raise ValueError("the curve must hold days 1..305")
    return F.element_at(F.array(*[F.lit(float(v)) for v in curve]), day.cast("int"))


def _in_horizon(df: DataFrame) -> DataFrame:
    return df.filter((F.col("dim") >= 1) & (F.col("dim") <= HORIZON))


def pivot_days(df: DataFrame) -> DataFrame:
    """Lactation x day matrix as one row per lactation: test_id, milk ARRAY<DOUBLE> of 305, gaps null.

    Repeated days are averaged. A record outside days 1..305 keeps its lactation but fills no slot.
    """
    inside = (F.col("dim") >= 1) & (F.col("dim") <= HORIZON)
    days = df.groupBy("test_id", F.when(inside, F.col("dim")).alias("dim")).agg(F.avg("milk_kg").alias("y"))
    nested = days.groupBy("test_id").agg(F.collect_list(F.when(F.col("dim").isNotNull(), F.struct("dim", "y"))).alias("m"))
    return nested.select("test_id", spread_days(F.col("m.dim"), F.col("m.y"), HORIZON, missing=None).alias("milk"))


def center_yields(df: DataFrame, curve: Sequence[float] | None = None) -> DataFrame:
    """Mean yield per lactation and day minus the standard curve, or minus the day's own mean.

    Without a curve the day means come from one partial aggregation to at most 305 rows, broadcast
    back, so a popular day is not gathered in one task.
    """
    days = _in_horizon(df).groupBy("test_id", "dim").agg(F.avg("milk_kg").alias("y"))
    if curve is not None:
        return days.select("test_id", "dim", (F.col("y") - _expected(curve, F.col("dim"))).alias("deviation"))
    means = days.groupBy("dim").agg(F.avg("y").alias("_mean"))
    joined = join_lookup(days, means, ["dim"], "inner", bounded=True)
    return joined.select("test_id", "dim", (F.col("y") - F.col("_mean")).alias("deviation"))


def deviation_vector(df: DataFrame, curve: Sequence[float], *, order: str = "pos") -> DataFrame:
    """Measured minus standard on measured days, 0 elsewhere: test_id, deviation ARRAY<DOUBLE> of 305."""
    last = dedup_day(_in_horizon(df), keep="last", order=order)
    entry = F.struct("dim", (F.col("milk_kg") - _expected(curve, F.col("dim"))).alias("v"))
    nested = last.groupBy("test_id").agg(F.collect_list(F.when(F.col("milk_kg").isNotNull(), entry)).alias("m"))
    return nested.select("test_id", spread_days(F.col("m.dim"), F.col("m.v"), HORIZON, missing=0.0).alias("deviation"))


def ar1_matrix(df: DataFrame, rho: Column, *, size: int) -> DataFrame:
    """rho**abs(i - j) for i, j in 1..size, per input row: the input columns, i, j, value."""
    i = df.withColumn("_rho", rho).withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(size))))
    ij = i.withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(size))))
    return ij.withColumn("value", F.pow("_rho", F.abs(F.col("i") - F.col("j")))).drop("_rho")


def ar1_covariance(b1: float, b2: float, rho: float, size: int = HORIZON) -> np.ndarray:
    """b1 * I + b2 * rho**abs(i - j) as a matrix."""
    day = np.arange(size)
    return b1 * np.eye(size) + b2 * rho ** np.abs(day[:, None] - day[None, :])


def deviations(df: DataFrame, curve: Sequence[float], *, order: str = "pos", keep: str = "last") -> DataFrame:
    """test_id and parallel arrays day, v of the measured deviations, ordered by day."""
    return _nest_deviations(dedup_day(_in_horizon(df), keep=keep, order=order), curve)


def _nest_deviations(days: DataFrame, curve: Sequence[float]) -> DataFrame:
    """Days to one row per lactation; a null day keeps its lactation but adds nothing."""
    deviation = F.col("milk_kg") - _expected(curve, F.col("dim"))
    entry = F.when(F.col("dim").isNotNull(), F.struct(F.col("dim").alias("day"), deviation.alias("v")))
    nested = days.groupBy("test_id").agg(F.array_sort(F.collect_list(entry)).alias("d"))
    return nested.select("test_id", F.col("d.day").alias("day"), F.col("d.v").alias("v"))


def _by_length(lengths: np.ndarray):
    for n in np.unique(lengths):
        if n > 0:
            yield int(n), np.flatnonzero(lengths == n)


def _blocks(batch: pa.RecordBatch, cells: int):
    """Lactations of a batch with equally many days together: days and values as matrices, in runs of about ``cells`` pairs of days."""
    day, _, lengths = flat(batch.column("day"))
    v, _, _ = flat(batch.column("v"))
    starts, days = np.cumsum(lengths) - lengths, day.astype(np.int64)
    for n, rows in _by_length(lengths):
        for part in np.array_split(rows, max(1, len(rows) * n * n // cells + 1)):
            at = starts[part][:, None] + np.arange(n)
            yield days[at], v[at]


def best_prediction_yield(
    df: DataFrame, curve: Sequence[float] | DataFrame, covariance: np.ndarray | DataFrame, *, order: str = "pos"
) -> DataFrame:
    """sum(curve) + 1'C V^-1 t over days 1..305: test_id, yield_kg.

    The last record of a day counts. A lactation without a usable day gets sum(curve). Only the
    column sums of the covariance and the block of the measured days are needed, so lactations with
    equally many days are solved together. The covariance is a fixed 305 x 305 matrix. Curve and covariance may
    also be tables, (day, expected_kg) and (i, j, cov), whose sizes are checked.
    """
    covariance, curve = covariance_values(covariance), curve_values(curve)
    column_sums = covariance.sum(axis=0)
    base = float(np.sum(curve))

    @F.arrow_udf("double")
    def predict(day: pa.Array, v: pa.Array) -> pa.Array:
        lengths = np.asarray(day.value_lengths().fill_null(0))
        starts = np.cumsum(lengths) - lengths
        days = np.asarray(day.flatten(), dtype=int) - 1
        values = np.asarray(v.flatten(), dtype=float)
        total = np.full(len(day), base)
        for n, rows in _by_length(lengths):
            for part in np.array_split(rows, max(1, len(rows) * n * n // 2_000_000 + 1)):
                at = starts[part][:, None] + np.arange(n)
                which = days[at]
                block = covariance[which[:, :, None], which[:, None, :]]
                alpha = np.linalg.solve(block, values[at][:, :, None])[:, :, 0]
                total[part] = base + (column_sums[which] * alpha).sum(axis=1)
        return pa.array(total)

    usable = F.col("milk_kg").isNotNull() & (F.col("dim") >= 1) & (F.col("dim") <= HORIZON)
    rows = df.select("test_id", *[F.when(usable, F.col(c)).alias(c) for c in ("dim", "milk_kg")], F.col(order))
    nested = _nest_deviations(dedup_day(rows, keep="last", order=order), curve)
    return nested.select("test_id", predict("day", "v").alias("yield_kg"))


def ar1_log_likelihood(deviations: DataFrame, candidates: np.ndarray) -> DataFrame:
    """Sums over all lactations per candidate (ratio, rho): candidate, n, log_det, quadratic.

    The covariance of one lactation is s * (ratio * I + rho**abs(i - j)) with the scale s left out.
    Each Arrow batch adds its lactations to one row per candidate; the batches are summed by Spark.
    """
    candidates = np.asarray(candidates, dtype=float)

    def sums(batches):
        out = np.zeros((len(candidates), 3))
        for batch in batches:
            for day, v in _blocks(batch, 200_000):
                gap = np.abs(day[:, :, None] - day[:, None, :])
                for k, (ratio, rho) in enumerate(candidates):
                    block = (rho ** np.arange(HORIZON + 0.0))[gap] + ratio * np.eye(day.shape[1])
                    lower = np.linalg.cholesky(block)
                    z = np.linalg.solve(lower, v[:, :, None])[:, :, 0]
                    log_det = 2 * np.log(np.einsum("rii->ri", lower)).sum()
                    out[k] += (v.size, log_det, (z * z).sum())
        cells = {"candidate": np.arange(len(candidates), dtype=np.int32), "n": out[:, 0], "log_det": out[:, 1], "quadratic": out[:, 2]}
        yield pa.RecordBatch.from_pydict({name: pa.array(values) for name, values in cells.items()})

    partial = deviations.select("day", "v").mapInArrow(sums, "candidate int, n double, log_det double, quadratic double")
    return partial.groupBy("candidate").agg(*[F.sum(c).alias(c) for c in ("n", "log_det", "quadratic")])


def _from_theta(theta: np.ndarray) -> tuple[float, float, float]:
    return float(np.exp(theta[0])), float(np.exp(theta[1])), float(1 / (1 + np.exp(-theta[2])))


#: Sums of one pass: negative log-likelihood, gradient and the upper half of the information matrix in (ln b1, ln b2, logit rho).
SCORES = ("n", "loss", "g0", "g1", "g2", "f00", "f01", "f02", "f11", "f12", "f22")


def ar1_scores(deviations: DataFrame, b1: float, b2: float, rho: float) -> DataFrame:
    """One row: negative log-likelihood of B = b1 I + b2 rho**abs(i - j) with its gradient and expected curvature.

    Derivatives are by (ln b1, ln b2, logit rho). Lactations with equally many days are worked on together; each Arrow batch adds its
    lactations to one row, and Spark sums the rows of the batches.
    """

    def sums(batches):
        out = np.zeros(len(SCORES))
        for batch in batches:
            for day, v in _blocks(batch, 100_000):
                out += _scores(day, v, b1, b2, rho)
        yield pa.RecordBatch.from_pydict({name: pa.array([value]) for name, value in zip(SCORES, out)})

    partial = deviations.select("day", "v").mapInArrow(sums, ", ".join(f"{c} double" for c in SCORES))
    return partial.agg(*[F.sum(c).alias(c) for c in SCORES])


def _scores(day: np.ndarray, v: np.ndarray, b1: float, b2: float, rho: float) -> np.ndarray:
    n = day.shape[1]
    gap = np.abs(day[:, :, None] - day[:, None, :])
    distance = np.arange(HORIZON + 0.0)
    # gaps are whole days, so their powers come from a table
    fading = (b2 * rho**distance)[gap]
    block = fading + b1 * np.eye(n)
    inverse = np.linalg.inv(block)
    alpha = (inverse @ v[:, :, None])[:, :, 0]
    loss = 0.5 * (np.linalg.slogdet(block)[1] + (v * alpha).sum(axis=1) + n * np.log(2 * np.pi))
    slopes = [fading, fading * ((1 - rho) * distance)[gap]]
    turned = [b1 * inverse, *[inverse @ d for d in slopes]]
    pulled = [b1 * alpha, *[(d @ alpha[:, :, None])[:, :, 0] for d in slopes]]
    gradient = [0.5 * (np.einsum("rii->r", t).sum() - (alpha * x).sum()) for t, x in zip(turned, pulled)]
    across = [t.transpose(0, 2, 1) for t in turned]
    curvature = [0.5 * (turned[i] * across[j]).sum() for i in range(3) for j in range(i, 3)]
    return np.array([v.size, loss.sum(), *gradient, *curvature])


def fit_ar1_covariance(
    df: DataFrame, curve: Sequence[float] | DataFrame, *, tolerance: float = 1e-6, most: int = 100, order: str = "pos"
) -> dict[str, float]:
    """Maximum likelihood of B = b1 I + b2 rho**abs(i - j) over a population: b1, b2, rho, the loss, passes and ``converged``.

    Starts at half the variance each and a correlation of 0.9 from day to day, and follows scoring steps: each pass is one job that sums
    loss, gradient and expected curvature over all lactations. A step that does not lower the loss is taken back and tried with
    more damping. Converged when a step is expected to lower the loss per record by less than ``tolerance`` squared and no parameter
    would move by more than ``tolerance`` to its scale; ``most`` passes without that return the best found, flagged.
    The deviations are written once, so every pass reads the same rows and a lost executor costs a rerun of its part only.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "deviations")
    measured = deviations(df.filter(F.col("milk_kg").isNotNull()), curve, order=order, keep="mean")
    measured.write.parquet(path)
    measured = spark.read.schema(measured.schema).parquet(path)
    flat = measured.select(F.explode("v").alias("v")).agg(F.count("v"), F.avg(F.col("v") * F.col("v"))).first()
    if not flat[0] or not flat[1]:
        raise ValueError("no measured deviations to fit")
    theta = np.array([np.log(flat[1] / 2), np.log(flat[1] / 2), np.log(0.9 / 0.1)])
    low, high = theta - np.array([30.0, 30.0, 30.0]), theta + np.array([10.0, 10.0, 15.0])
    best, damping, converged, passes = None, 1e-4, False, 0
    trial = theta
    while passes < most:
        row = ar1_scores(measured, *_from_theta(trial)).first()
        passes += 1
        if best is None or row["loss"] < best[0]["loss"]:
            damping = max(damping / 10, 1e-10)
            best = (row, trial)
        else:
            damping *= 10
        state, at = best
        gradient = np.array([state[f"g{i}"] for i in range(3)])
        curvature = np.array([[state[f"f{min(i, j)}{max(i, j)}"] for j in range(3)] for i in range(3)])
        held = ((at <= low) & (gradient > 0)) | ((at >= high) & (gradient < 0))
        free = ~held
        if not free.any():
            converged = True
            break
        part = curvature[np.ix_(free, free)]
        step = np.zeros(3)
        step[free] = -np.linalg.lstsq(part + damping * np.diag(np.diag(part) + 1e-12), gradient[free], rcond=None)[0]
        gain = -(gradient @ step) / 2
        if gain / state["n"] < tolerance**2 and (np.abs(step) < tolerance * 1e3).all() or damping > 1e12:
            converged = damping <= 1e12 or gain / state["n"] < tolerance
            break
        trial = np.clip(at + np.clip(step, -2.0, 2.0), low, high)
    b1, b2, rho = _from_theta(best[1])
    return {"b1": b1, "b2": b2, "rho": rho, "neg_log_likelihood": float(best[0]["loss"]), "passes": passes, "converged": bool(converged)}


def curve_values(curve: Sequence[float] | DataFrame) -> list[float]:
    """Days 1..305 of a standard curve given as numbers or as a table (day or dim, expected_kg or milk_kg).

    The table must hold each of the days once (day 0 is passed over); one row more than that is read at most.
    """
    if not isinstance(curve, DataFrame):
        return [float(v) for v in curve]
    day = next(c for c in ("day", "dim") if c in curve.columns)
    value = next(c for c in ("expected_kg", "milk_kg") if c in curve.columns)
    rows = curve.filter((F.col(day) >= 1) & (F.col(day) <= HORIZON)).select(day, value).limit(HORIZON + 1).collect()
    held = {int(r[0]): r[1] for r in rows}
    if len(rows) != HORIZON or len(held) != HORIZON or None in held.values():
        raise ValueError("the curve must hold days 1..305 once each")
    return [float(held[d]) for d in range(1, HORIZON + 1)]


def covariance_values(covariance: np.ndarray | DataFrame) -> np.ndarray:
    """The 305 x 305 covariance given as a matrix or as a table (i, j, cov) of days 1..305, each pair once."""
    if isinstance(covariance, DataFrame):
        table = covariance.select(F.col("i").cast("int"), F.col("j").cast("int"), F.col("cov").cast("double"))
        rows = table.limit(HORIZON * HORIZON + 1).toPandas()
        matrix = np.full((HORIZON, HORIZON), np.nan)
        inside = rows["i"].between(1, HORIZON) & rows["j"].between(1, HORIZON)
        if len(rows) != HORIZON * HORIZON or not inside.all():
            raise ValueError("the covariance must hold each pair of days 1..305 once")
        matrix[rows["i"] - 1, rows["j"] - 1] = rows["cov"]
        covariance = matrix
    covariance = np.asarray(covariance, dtype=float)
    if covariance.shape != (HORIZON, HORIZON) or not np.isfinite(covariance).all():
        raise ValueError("the covariance must be 305 x 305")
    return covariance
