"""Model-ready rows: named transforms in a configured order, features, and batch scoring."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from dairyframe.functions import arrays as ar
from dairyframe.functions.daily import sums
from dairyframe.functions.gap_fill import fill_lists
from dairyframe.operators import herd, lookups
from dairyframe.operators.characteristics import curve_shape_stats

Transform = Callable[[DataFrame], DataFrame]
REGISTRY: dict[str, Callable[..., Transform]] = {}


def register(name: str) -> Callable[[Callable[..., Transform]], Callable[..., Transform]]:
    """Add a transform factory (parameters in, DataFrame -> DataFrame out) under ``name``."""

    def add(factory: Callable[..., Transform]) -> Callable[..., Transform]:
        if name in REGISTRY:
            raise ValueError(f"transform {name!r} registered twice")
        REGISTRY[name] = factory
        return factory

    return add


def create(name: str, **params) -> Transform:
    """Build one transform; unknown names and parameters that do not fit raise."""
    if name not in REGISTRY:
        raise ValueError(f"unknown transform {name!r}; known: {', '.join(sorted(REGISTRY))}")
    try:
        inspect.signature(REGISTRY[name]).bind(**params)
    except TypeError as error:
        raise ValueError(f"bad parameters for transform {name!r}: {error}") from error
    return REGISTRY[name](**params)


def transform_chain(df: DataFrame, specs: Sequence[Mapping]) -> DataFrame:
    """Apply configured transforms in order; a spec is ``{'name': ..., **params}``. Stays lazy."""
    for spec in specs:
        params = dict(spec)
        df = df.transform(create(params.pop("name"), **params))
    return df


@register("imputation")
def _imputation(method: str = "forward_fill", field: str = "milk") -> Transform:
    return lambda df: df.withColumn(field, ar.impute(F.col(field), method))


@register("sequence_normalization")
def _normalization(method: str = "zscore", field: str = "milk", scale: float | None = None) -> Transform:
    rules = {"zscore": ar.zscore, "minmax": ar.minmax, "maxabs": ar.maxabs}
    if method == "scale":
        if scale is None:
            raise ValueError("'scale' needs the parameter scale")
        return lambda df: df.withColumn(field, ar.scale(F.col(field), scale))
    if method not in rules:
        raise ValueError(f"unknown normalization {method!r}")
    return lambda df: df.withColumn(field, rules[method](F.col(field)))


@register("sequence_padding")
def _padding(max_length: int, field: str = "milk", pad_value: float = 0.0, mode: str = "post") -> Transform:
    return lambda df: df.withColumn(field, ar.pad_truncate(F.col(field), max_length, F.lit(pad_value), mode=mode))


@register("windowing")
def _windowing(window_size: int, stride: int = 1, field: str = "milk", first_only: bool = True) -> Transform:
    def first(df: DataFrame) -> DataFrame:
        return df.withColumn(field, F.slice(F.col(field), 1, window_size))

    def every(df: DataFrame) -> DataFrame:
        others = [c for c in df.columns if c != field]
        rows = df.select(*others, F.inline(ar.windows(F.col(field), window_size, stride)))
        return rows.withColumnRenamed("values", field).withColumnRenamed("start", "window_start")

    return first if first_only else every


@register("milk_normalization")
def _milk(max_milk: float = ar.MILK_SCALE) -> Transform:
    return lambda df: df.withColumn("milk", ar.milk_scale(F.col("milk"), max_milk))


@register("herd_stats_normalization")
def _stats(method: str = "zscore", epsilon: float = 1e-6) -> Transform:
    rules = {"zscore": ar.stats_zscore, "minmax": ar.stats_minmax}
    if method not in rules:
        raise ValueError(f"unknown normalization {method!r}")
    return lambda df: df.withColumn("herd_stats", rules[method](F.col("herd_stats"), epsilon))


@register("event_tokenization")
def _tokens(dictionary: Mapping[str, int], unknown_event: str = "unknown") -> Transform:
    return lambda df: df.withColumn("events", lookups.event_tokens(F.col("events"), dictionary, unknown=unknown_event))


@register("herd_stats_enrichment")
def _enrichment(per_herd_parity: DataFrame, per_herd: DataFrame, per_parity: DataFrame, overall: Mapping[str, float]) -> Transform:
    def enrich(df: DataFrame) -> DataFrame:
        rows = lookups.hierarchical_stats(df, per_herd_parity, per_herd, per_parity, overall)
        return rows.withColumn("herd_stats", herd.stats_vector(F.col("stats"))).drop("stats")

    return enrich


def _needed(name: str) -> Column:
    return F.coalesce(F.col(name), F.raise_error(F.lit(f"field {name} is missing")).cast(_TYPES[name]))


_TYPES = {"milk": "array<double>", "events": "array<int>", "parity": "double", "herd_stats": "array<double>"}


def feature_rows(df: DataFrame, *, max_days: int = ar.HORIZON, id_column: str = "animal_id") -> DataFrame:
    """features STRUCT<milk, events, parity, herd_stats>, label and metadata per record.

    In: ``id_column``, herd_id, parity, milk, events (token indices), herd_stats. Sequences are cut or
    zero-padded to ``max_days``; a missing field fails the job.
    """
    milk = ar.pad_truncate(_needed("milk"), max_days, F.lit(0.0)).cast("array<float>")
    events = ar.pad_truncate(_needed("events"), max_days, F.lit(0)).cast("array<int>")
    checked = df.withColumn("parity", F.col("parity").cast("double"))
    return checked.select(
        F.struct(
            milk.alias("milk"),
            events.alias("events"),
            F.array(_needed("parity")).cast("array<float>").alias("parity"),
            _needed("herd_stats").cast("array<float>").alias("herd_stats"),
        ).alias("features"),
        milk.alias("label"),
        F.struct(F.col(id_column).alias("animal_id"), "herd_id", "parity").alias("metadata"),
    )


def feature_vector(df: DataFrame, feature_keys: Sequence[str], label_key: str | None = None) -> DataFrame:
    """Only the named feature columns, and the label."""
    label = [F.col(label_key).alias("label")] if label_key else []
    return df.select(F.struct(*feature_keys).alias("features"), *label)


Scorer = Callable[[pd.DataFrame], np.ndarray]


def scaled_mean_curve(curve: Sequence[float]) -> Scorer:
    """Scorer without a network: the population mean curve, scaled to the mean of the lactation."""
    shape = np.asarray(curve, dtype=float)

    def score(batch: pd.DataFrame) -> np.ndarray:
        milk = np.stack(batch["milk"].to_list()).astype(float)
        seen = milk > 0
        expected = (seen * shape).sum(axis=1)
        level = np.divide(milk.sum(axis=1), expected, out=np.ones(len(milk)), where=expected > 0)
        return level[:, None] * shape

    return score


LEVELS = ("raw", "base", "rich")
#: Sequences scored at a time.
SCORED = 512


def _predictions(found: np.ndarray) -> pa.Array:
    """Rows of numbers as lists; NaN becomes null."""
    if isinstance(found, np.ndarray) and found.ndim == 2:
        values = found.astype(float).ravel()
        offsets = np.arange(0, found.size + 1, max(found.shape[1], 1), dtype=np.int32) if found.shape[1] else np.zeros(len(found) + 1, np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, from_pandas=True))
    return pa.array([None if row is None else np.asarray(row, dtype=float) for row in found], pa.list_(pa.float64()), from_pandas=True)


def score_batch(
    df: DataFrame,
    scorer: Scorer | None = None,
    *,
    setup: Callable[[], Scorer] | None = None,
    level: str = "base",
    id_column: str = "test_id",
    default_imputation: str = "forward_fill",
    late_day: int = 200,
) -> DataFrame:
    """Apply a scorer to daily sequences in Arrow batches, with one of three levels of output.

    ``raw`` gives id and predictions, ``base`` adds total_kg, ``rich`` a struct ``shape`` of peak_yield, time_to_peak, cumulative_yield
    and persistency (yield of ``late_day``, or of the last day, over the peak). Give a ``scorer``, or ``setup``, which makes one
    and is called once per task, before its first batch: models are loaded there and need not be pickled.

    In: ``id_column``, milk ARRAY<DOUBLE> of the horizon, optionally ``imputation_method`` per row, which
    overrides the default. Gaps an imputation leaves open are read as 0. A scorer has to return one row of numbers per
    sequence.

    A task fills gaps, scores and adds up SCORED sequences at a time in one Python worker: whole Arrow batches of long sequences, held by
    a worker for each of these steps, would take gigabytes of an executor.
    """
    if level not in LEVELS:
        raise ValueError(f"level must be one of {', '.join(LEVELS)}")
    if (scorer is None) == (setup is None):
        raise ValueError("give either a scorer or a setup function")
    method = F.col("imputation_method") if "imputation_method" in df.columns else F.lit(None).cast("string")
    others = [c for c in df.columns if c not in ("milk", "imputation_method")]
    ready = df.select(*others, "milk", ar.imputation(method, default_imputation).alias("imputation_method"))

    def run(batches):
        score = scorer
        for batch in batches:
            for first in range(0, len(batch), SCORED):
                part = batch.slice(first, SCORED)
                score = score or setup()
                milk = fill_lists(part.column("milk"), np.asarray(part.column("imputation_method").to_pylist(), dtype=object), zeros=True)
                found = score(pa.RecordBatch.from_arrays([*[part.column(c) for c in others], milk], names=[*others, "milk"]).to_pandas())
                if len(found) != len(part):
                    raise ValueError(f"the scorer returned {len(found)} predictions for {len(part)} sequences")
                predictions = _predictions(found)
                columns = [part.column(id_column), predictions]
                if level != "raw":
                    total, gaps = sums(predictions)
                    none = np.asarray(predictions.is_null())
                    columns += [pa.array(total, mask=none), pa.array(total, mask=none | gaps)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [id_column, "predictions"] + ["total_kg", "_sum"] * (level != "raw")
    kinds = [dict(df.dtypes)[id_column], "array<double>", "double", "double"]
    scored = ready.mapInArrow(run, ", ".join(f"{name} {kind}" for name, kind in zip(names, kinds)))
    if level != "rich":
        return scored.drop("_sum")
    shape = F.struct(*curve_shape_stats(F.col("predictions"), late_day=late_day, cumulative=F.col("_sum")))
    return scored.withColumn("shape", shape).drop("_sum")
