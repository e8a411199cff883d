"""Interpolation on the fixed grid of days, and yields predicted from a standard curve.

One lactation becomes one row with an array of its days (day, first, last yield), built after the
per-day aggregation, so the array is no longer than the days of a lactation. All grid work is then a
narrow map over that array: no range join, no cross join, no window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from dairyframe.functions.arrays import let
from dairyframe.functions.daily import flat
from dairyframe.functions.grid import filled_area, nearest_known, standard_values
from dairyframe.operators import fitting
from dairyframe.operators.yields import collapse_days

# The inner grid days; the wide grid adds day 0 and day 305.
GRID_DAYS = (10, 30, 50, 70, 90, 110, 130, 150, 170, 190, 210, 230, 250, 270, 290)
WIDE_GRID = (0, *GRID_DAYS, 305)
HORIZON = 305
INTERVAL, LAST_INTERVAL = 20, 25
FLAT_KG = 1e-9


@dataclass(frozen=True)
class Standard:
    """A population standard: expected yield on days 0..305, and correlation and std per grid day."""

    curve: Sequence[float]
    correlation: Sequence[Sequence[float]]
    std: Sequence[float]
    grid: Sequence[int] = WIDE_GRID

    def __post_init__(self) -> None:
        n = len(self.grid)
        if len(self.curve) != HORIZON + 1:
            raise ValueError("the curve must hold days 0..305")
        if len(self.std) != n or len(self.correlation) != n or any(len(r) != n for r in self.correlation):
            raise ValueError(f"correlation and std must match the {n} grid days")

    @classmethod
    def from_days_1_to_305(cls, curve: Sequence[float], correlation, std, grid=WIDE_GRID) -> "Standard":
        """Day 0 repeats day 1."""
        return cls([curve[0], *curve], correlation, std, grid)

    @classmethod
    def from_tables(cls, curve: DataFrame, correlation: DataFrame, std: DataFrame, grid: Sequence[int] = WIDE_GRID) -> "Standard":
        """From tables (day, expected_kg), (day_i, day_p, corr) and (day, std).

        Each day and pair has to be there once, day 0 of the curve may be missing (it repeats day 1). At most one row more than
        that is read, so a table of another size is refused without being gathered.
        """
        days = _keyed(curve.filter((F.col("day") >= 0) & (F.col("day") <= HORIZON)), ["day"], "expected_kg", HORIZON + 1)
        days.setdefault((0,), days.get((1,)))
        values = [days.get((d,)) for d in range(HORIZON + 1)]
        pairs = _keyed(correlation, ["day_i", "day_p"], "corr", len(grid) ** 2)
        spread = _keyed(std, ["day"], "std", len(grid))
        matrix = [[pairs.get((i, p)) for p in grid] for i in grid]
        row = [spread.get((g,)) for g in grid]
        if None in values or None in row or any(None in r for r in matrix):
            raise ValueError(f"the tables must hold days 0..{HORIZON} and every pair of the {len(grid)} grid days")
        return cls(values, matrix, row, grid)

    def factor(self) -> list[list[float]]:
        """b[i][p] = corr(i, p) * std(p) / std(i), 0 where std(i) is 0."""
        return [
            [0.0 if self.std[i] == 0 else float(self.correlation[i][p]) * self.std[p] / self.std[i] for p in range(len(self.grid))]
            for i in range(len(self.grid))
        ]


def _keyed(table: DataFrame, keys: Sequence[str], value: str, most: int) -> dict[tuple, float]:
    rows = table.select(*keys, F.col(value).cast("double").alias("_value")).limit(most + 1).collect()
    found = {tuple(int(r[k]) for k in keys): r["_value"] for r in rows}
    if len(rows) > most or len(found) < len(rows):
        raise ValueError(f"{value}: more than {most} rows, or a repeated {' and '.join(keys)}")
    return found


def _doubles(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _at(values: Column, day: Column) -> Column:
    """Value for a day of an array that starts at day 0; null outside."""
    return F.when(day >= 0, F.try_element_at(values, (day + 1).cast("int")))


def day_arrays(df: DataFrame, *, order: str = "pos", max_dim: int | None = HORIZON) -> DataFrame:
    """test_id and days ARRAY<STRUCT<day, first, last>> ordered by day."""
    usable = df.filter(F.col("dim").isNotNull())
    if max_dim is not None:
        usable = usable.filter(F.col("dim") <= max_dim)
    entry = F.struct(F.col("dim").alias("day"), F.col("first_milk").alias("first"), F.col("last_milk").alias("last"))
    return collapse_days(usable, order=order).groupBy("test_id").agg(F.array_sort(F.collect_list(entry)).alias("days"))


def _before(days: Column, g: Column) -> Column:
    return F.array_max(F.filter(days, lambda d: d["day"] < g))


def _after(days: Column, g: Column) -> Column:
    return F.array_min(F.filter(days, lambda d: d["day"] > g))


def _same(days: Column, g: Column) -> Column:
    return F.array_min(F.filter(days, lambda d: d["day"] == g))


def bracket_days(df: DataFrame, *, grid: Sequence[int] = WIDE_GRID, order: str = "pos") -> DataFrame:
    """For each grid day the last measured day before it and the first one after it, with yields."""
    brackets = F.transform(
        F.array(*[F.lit(g) for g in grid]),
        lambda g: F.struct(g.alias("grid_day"), _before(F.col("days"), g).alias("b"), _after(F.col("days"), g).alias("a")),
    )
    return day_arrays(df, order=order).select("test_id", F.inline(brackets)).select(
        "test_id",
        "grid_day",
        F.col("b.day").alias("before_day"),
        F.col("b.first").alias("before_milk"),
        F.col("a.day").alias("after_day"),
        F.col("a.first").alias("after_milk"),
    )


def _around(days: Column, g: Column) -> Column:
    """The record on a grid day and its neighbours: STRUCT<e, b, a>, each null when there is none."""
    return F.struct(_same(days, g).alias("e"), _before(days, g).alias("b"), _after(days, g).alias("a"))


def _linear_value(days: Column, g: Column) -> Column:
    """Linear yield of grid day g inside the measured range, null outside."""

    def value(s: Column) -> Column:
        exact, b, a = s["e"], s["b"], s["a"]
        between = b["first"] + (a["first"] - b["first"]) / (a["day"] - b["day"]) * (g - b["day"])
        return F.when(exact.isNotNull(), exact["first"]).when(b.isNotNull() & a.isNotNull(), between)

    return let(_around(days, g), value)


def _linear_or_extended(days: Column, g: Column) -> Column:
    """Linear yield inside the range; outside, the line through the two outermost records.

    Null for lactations with a single day, which have no line.
    """
    n = F.size(days)

    def line(p: Column, q: Column) -> Column:
        return p["first"] + (q["first"] - p["first"]) / (q["day"] - p["day"]) * (g - p["day"])

    head = line(F.get(days, F.lit(0)), F.get(days, F.lit(1)))
    tail = line(F.get(days, n - 2), F.get(days, n - 1))
    return F.when(n >= 2, F.coalesce(_linear_value(days, g), F.when(_before(days, g).isNull(), head).otherwise(tail)))


def _on_grid(arrays: DataFrame, grid: Sequence[int], value: Callable[[Column, Column], Column]) -> DataFrame:
    points = F.transform(
        F.array(*[F.lit(g) for g in grid]),
        lambda g: F.struct(g.alias("grid_day"), value(F.col("days"), g).alias("milk_kg")),
    )
    long = arrays.select("test_id", F.inline(points))
    return long.filter(F.col("milk_kg").isNotNull())


def interp_standard_curve(
    df: DataFrame, curve: Sequence[float], *, grid: Sequence[int] = WIDE_GRID, order: str = "pos"
) -> DataFrame:
    """Grid yields along the standard curve: test_id, grid_day, milk_kg.

    Measured grid days are copied; nothing outside the measured range, nor where the measured day to
    the right is at or beyond 305. The first record of a day counts.
    """
    rows = _with_values(day_arrays(df, order=order), curve, grid)
    return _by_grid_day(rows, grid, "_v", "milk_kg")


def interp_linear_all(df: DataFrame, *, grid: Sequence[int] = WIDE_GRID, order: str = "pos") -> DataFrame:
    """Linear interpolation and extrapolation to every grid day."""
    return _on_grid(day_arrays(df, order=order), grid, _linear_or_extended)


def interp_linear_range(df: DataFrame, *, grid: Sequence[int] = WIDE_GRID, order: str = "pos") -> DataFrame:
    """Linear interpolation to the grid days inside the measured range."""
    return _on_grid(day_arrays(df, order=order), grid, _linear_value)


def measured_or_interpolated(measured: DataFrame, interpolated: DataFrame) -> DataFrame:
    """Full outer of measured and grid days on (lactation, day); the measured yield wins.

    Both sides hold a day at most once per lactation.
    """
    left = measured.select("test_id", "dim", F.col("milk_kg").alias("_m"))
    right = interpolated.select("test_id", F.col("grid_day").alias("dim"), F.col("milk_kg").alias("_i"))
    return left.join(right, ["test_id", "dim"], "full").select(
        "test_id", "dim", F.coalesce("_m", "_i").alias("milk_kg"), F.col("_m").isNotNull().alias("measured")
    )


def _nearest(available: Column, g: Column) -> Column:
    """Nearest of the available grid points, the lower day on ties."""
    return F.array_min(F.transform(available, lambda p: F.struct(F.abs(p["day"] - g).alias("gap"), p["day"].alias("day"), p["y"].alias("y"))))


def nearest_grid_days(df: DataFrame, curve: Sequence[float], *, grid: Sequence[int] = WIDE_GRID, order: str = "pos") -> DataFrame:
    """For each missing grid day the nearest available one: test_id, grid_day, nearest_day."""
    rows = _with_values(day_arrays(df, order=order), curve, grid)
    return _by_grid_day(rows.select("test_id", nearest_known(F.col("_v"), grid).alias("_n")), grid, "_n", "nearest_day")


def _with_values(arrays: DataFrame, curve: Sequence[float], grid: Sequence[int]) -> DataFrame:
    """Adds _v ARRAY<DOUBLE>: the interpolated yield of each grid day, null where there is none."""
    return arrays.withColumn("_v", standard_values(F.col("days"), curve, grid))


def _by_grid_day(rows: DataFrame, grid: Sequence[int], values: str, name: str) -> DataFrame:
    """One row per lactation and grid day that has a value: test_id, grid_day and ``name``."""
    points = F.arrays_zip(F.array(*[F.lit(int(g)) for g in grid]).alias("grid_day"), F.col(values).alias("value"))
    long = rows.select("test_id", F.inline(points)).toDF("test_id", "grid_day", name)
    return long.filter(F.col(name).isNotNull())


def _with_points(arrays: DataFrame, curve: Sequence[float], grid: Sequence[int]) -> DataFrame:
    """Adds points ARRAY<STRUCT<day, y>>: the grid days that could be interpolated."""
    every = F.arrays_zip(F.array(*[F.lit(int(g)) for g in grid]).alias("day"), F.col("_v").alias("y"))
    return _with_values(arrays, curve, grid).withColumn("points", F.filter(every, lambda p: p["y"].isNotNull())).drop("_v")


def islc_yield(df: DataFrame, standard: Standard, *, order: str = "pos", max_dim: int = HORIZON) -> DataFrame:
    """Interpolation using standard lactation curves: test_id, yield_kg.

    Measured days (the last record of a day) are joined by interpolated grid days; each grid day still
    missing gets g_p + b * (y_i - g_i) from the nearest interpolated grid day i; trapezoids over all
    days present, day 0 included. Null when no grid day could be interpolated.
    """
    grid = list(standard.grid)
    if 0 not in grid or HORIZON not in grid:
        raise ValueError("islc_yield needs the wide grid with days 0 and 305")
    rows = day_arrays(df, order=order, max_dim=max_dim)
    return rows.select("test_id", filled_area(F.col("days"), standard.curve, grid, standard.factor()).alias("yield_kg"))


def islc_original_yield(df: DataFrame, standard: Standard, *, order: str = "pos", max_dim: int = HORIZON) -> DataFrame:
    """The grid-only form: test_id, yield_kg.

    Known grid days plus the standard of the missing ones, 20 days each and 25 for day 290, plus the
    summed b of the missing days times the last known day's deviation. When day 290 is known the last
    missing day's b is left out. Restricted to the fifteen inner days; null with none of them.
    """
    grid = list(standard.grid)
    if tuple(grid) != GRID_DAYS:
        raise ValueError("islc_original_yield needs the fifteen inner grid days")
    curve = _doubles(standard.curve)
    slots = F.create_map(*[F.lit(x) for i, g in enumerate(grid) for x in (g, i)])
    factor = F.array(*[_doubles(row) for row in standard.factor()])
    rows = _with_points(day_arrays(df, order=order, max_dim=max_dim), standard.curve, grid)
    last = F.element_at("points", -1)
    missing = F.filter(F.array(*[F.lit(g) for g in grid]), lambda g: ~F.exists("points", lambda p: p["day"] == g))

    def weight(day: Column) -> Column:
        return F.when(day == GRID_DAYS[-1], LAST_INTERVAL).otherwise(INTERVAL).cast("double")

    def b(g: Column) -> Column:
        return F.element_at(F.element_at(factor, slots[_nearest(F.col("points"), g)["day"]] + 1), slots[g] + 1)

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)

    rows = rows.filter(F.size("points") >= 0).withColumn("missing", missing)
    known = total(F.transform("points", lambda p: p["y"] * weight(p["day"])))
    expected = total(F.transform("missing", lambda g: _at(curve, g) * weight(g)))
    ends_known = F.exists("points", lambda p: p["day"] == GRID_DAYS[-1])
    weighed = F.when(ends_known, F.slice("missing", 1, F.greatest(F.size("missing") - 1, F.lit(0)))).otherwise(F.col("missing"))
    correction = total(F.transform(weighed, lambda g: b(g) * weight(g))) * (last["y"] - _at(curve, last["day"]))
    return rows.select("test_id", F.when(F.size("points") > 0, known + expected + correction).alias("yield_kg"))


@dataclass(frozen=True)
class Representation:
    """correlation: (day_i, day_p, corr); std: (day, std); params: one row of curve parameters."""

    correlation: DataFrame
    std: DataFrame
    params: DataFrame


Interpolation = Callable[..., DataFrame]
#: (days, yields, curve, grid) -> a yield per grid day, NaN where there is none; plain numpy arrays of one lactation.
GridFunction = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def per_lactation(fn: GridFunction) -> Interpolation:
    """An interpolation from a caller's function of one lactation.

    Records are reduced to days and nested in Spark, the first record of a day counts, and days beyond 305 are left out; ``fn`` then
    runs inside tasks, over Arrow batches, once per lactation. What it returns is checked: one number per grid day, no infinity.
    """

    def interpolate(df: DataFrame, curve: Sequence[float], *, grid: Sequence[int] = WIDE_GRID, order: str = "pos") -> DataFrame:
        curve_array, grid_array = np.asarray(curve, dtype=float), np.asarray(grid, dtype=int)
        size = len(grid_array)

        @F.arrow_udf("array<double>")
        def run(day: pa.Array, milk: pa.Array) -> pa.Array:
            offsets = np.concatenate([[0], np.cumsum(np.asarray(day.value_lengths().fill_null(0)))])
            days, yields = np.asarray(day.flatten(), dtype=int), np.asarray(milk.flatten(), dtype=float)
            out = np.full((len(day), size), np.nan)
            for i, (start, end) in enumerate(zip(offsets[:-1], offsets[1:])):
                value = np.asarray(fn(days[start:end], yields[start:end], curve_array, grid_array), dtype=float)
                if value.shape != (size,) or np.isinf(value).any():
                    raise ValueError(f"the interpolation must return {size} numbers or NaN, one per grid day; got shape {value.shape}")
                out[i] = value
            flat = pa.array(out.ravel(), mask=np.isnan(out.ravel()))
            return pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, size, dtype=np.int32)), flat)

        rows = day_arrays(df.filter(F.col("milk_kg").isNotNull()), order=order)
        values = rows.select("test_id", run(F.col("days.day"), F.col("days.first")).alias("_v"))
        points = F.arrays_zip(F.array(*[F.lit(int(g)) for g in grid]).alias("grid_day"), F.col("_v").alias("milk_kg"))
        long = values.select("test_id", F.inline(points)).toDF("test_id", "grid_day", "milk_kg")
        return long.filter(F.col("milk_kg").isNotNull())

    return interpolate


def standardized_grid(points: DataFrame) -> DataFrame:
    """Grid yields scaled per lactation to mean 0 and sample std 1: test_id, grid ARRAY<STRUCT<grid_day, z>>.

    A lactation has at most as many points as the grid has days. One whose spread is below 1e-9 kg is
    constant up to rounding and has no scaled form.
    """
    rows = points.groupBy("test_id").agg(
        F.avg("milk_kg").alias("_m"),
        F.stddev_samp("milk_kg").alias("_s"),
        F.collect_list(F.struct("grid_day", "milk_kg")).alias("_g"),
    )
    usable = F.col("_s") > FLAT_KG
    scaled = F.transform("_g", lambda p: F.struct(p["grid_day"].alias("grid_day"), ((p["milk_kg"] - F.col("_m")) / F.col("_s")).alias("z")))
    return rows.filter(usable).select("test_id", scaled.alias("grid"))


def grid_moments(scaled: DataFrame, grid: Sequence[int]) -> DataFrame:
    """Pairwise-complete sums per pair of grid days: day_i, day_p, n, si, sp, sii, spp, sip.

    Each Arrow batch yields one small matrix product per sum instead of pairs per lactation; the
    batches are then added up, grid x grid rows each.
    """
    size = len(grid)
    index = np.zeros(max(grid) + 1, dtype=np.int64)
    index[list(grid)] = np.arange(size)
    names = ("n", "si", "sp", "sii", "spp", "sip")

    def moments(batches):
        sums = {name: np.zeros((size, size)) for name in names}
        for batch in batches:
            z = np.zeros((len(batch), size))
            mask = np.zeros((len(batch), size))
            day, _, lengths = flat(batch.column("days"))
            rows = np.repeat(np.arange(len(batch)), lengths)
            if len(rows):
                slots = index[day.astype(np.int64)]
                z[rows, slots] = flat(batch.column("z"))[0]
                mask[rows, slots] = 1.0
            sums["n"] += mask.T @ mask
            sums["si"] += z.T @ mask
            sums["sp"] += mask.T @ z
            sums["sii"] += (z * z).T @ mask
            sums["spp"] += mask.T @ (z * z)
            sums["sip"] += z.T @ z
        i, p = np.divmod(np.arange(size * size), size)
        days = np.asarray(grid)
        cells = {"day_i": days[i].astype(np.int32), "day_p": days[p].astype(np.int32), **{n: v.ravel() for n, v in sums.items()}}
        yield pa.RecordBatch.from_pydict({name: pa.array(values) for name, values in cells.items()})

    schema = "day_i int, day_p int, " + ", ".join(f"{n} double" for n in names)
    nested = scaled.select(F.col("grid.grid_day").alias("days"), F.col("grid.z").alias("z"))
    partial = nested.mapInArrow(moments, schema)
    return partial.groupBy("day_i", "day_p").agg(*[F.sum(n).alias(n) for n in names])


def standard_representation(
    df: DataFrame,
    curve: Sequence[float],
    *,
    grid: Sequence[int] = WIDE_GRID,
    interpolation: Interpolation | None = None,
    model: str = "wilmink",
    order: str = "pos",
) -> Representation:
    """Standard of a population: interpolate, scale per lactation, correlate grid days, refit the curve.

    ``interpolation`` is any function (df, curve, grid=, order=) -> test_id, grid_day, milk_kg; ``per_lactation`` makes one
    of a plain numpy function of one lactation.
    Correlations use the lactations that have both days; std per day is the population form.
    """
    if interpolation is None:
        points = interp_standard_curve(df, curve, grid=grid, order=order)
    else:
        points = interpolation(df, curve, grid=grid, order=order)
    sums = grid_moments(standardized_grid(points), list(grid))
    n, si, sp, sii, spp, sip = (F.col(c) for c in ("n", "si", "sp", "sii", "spp", "sip"))
    spread = F.sqrt((n * sii - si * si) * (n * spp - sp * sp))
    correlation = sums.select("day_i", "day_p", F.when((n >= 2) & (spread > 0), (n * sip - si * sp) / spread).alias("corr"), "n")
    std = sums.filter((F.col("day_i") == F.col("day_p")) & (n > 0)).select(
        F.col("day_i").alias("day"), F.sqrt(F.greatest(sii / n - (si / n) * (si / n), F.lit(0.0))).alias("std")
    )
    params = fitting.fit_population_curve(points.withColumnRenamed("grid_day", "dim"), model)
    return Representation(correlation, std, params)


def collect_standard(representation: Representation, *, grid: Sequence[int] = WIDE_GRID) -> Standard:
    """The small standard tables (grid x grid, grid, one curve) as driver-side arrays.

    Days or pairs the population never had get correlation and std 0.
    """
    size = len(grid)
    index = {g: i for i, g in enumerate(grid)}
    correlation = [[0.0] * size for _ in range(size)]
    for row in representation.correlation.collect():
        correlation[index[row["day_i"]]][index[row["day_p"]]] = row["corr"] or 0.0
    std = [0.0] * size
    for row in representation.std.collect():
        std[index[row["day"]]] = row["std"]
    daily = fitting.predict_curve(representation.params).filter(F.col("day") <= HORIZON)
    curve = [row["milk_kg"] for row in daily.orderBy("day").collect()]
    return Standard.from_days_1_to_305(curve, correlation, std, grid)
