"""Detection tables and media metadata: boxes, filters, summaries, image and frame geometry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from dairyframe.operators import chunks
from dairyframe.operators.skew import join_lookup

BOX_FORMATS = ("xyxy", "xywh", "ltwh")


def _check(*formats: str) -> None:
    for fmt in formats:
        if fmt not in BOX_FORMATS:
            raise ValueError(f"box format must be one of {', '.join(BOX_FORMATS)}, not {fmt!r}")


def box_convert(box: Sequence[Column], source: str, target: str) -> list[Column]:
    """Four columns of one format to another: corners, centre and size, or left-top and size."""
    _check(source, target)
    p, q, r, s = box
    if source == target:
        return [p, q, r, s]
    corners = {
        "xyxy": (p, q, r, s),
        "xywh": (p - r / 2, q - s / 2, p + r / 2, q + s / 2),
        "ltwh": (p, q, p + r, q + s),
    }[source]
    x1, y1, x2, y2 = corners
    return {
        "xyxy": [x1, y1, x2, y2],
        "xywh": [(x1 + x2) / 2, (y1 + y2) / 2, x2 - x1, y2 - y1],
        "ltwh": [x1, y1, x2 - x1, y2 - y1],
    }[target]


def box_standardize(df: DataFrame, target: str, *, box: Sequence[str] = ("p", "q", "r", "s"), fmt: str = "box_format") -> DataFrame:
    """Convert each row by its own format tag; ``converted_from`` holds the old tag when it changed.

    Rows without a known tag keep their box and tag.
    """
    _check(target)
    cols = [F.col(c) for c in box]
    converted = {source: box_convert(cols, source, target) for source in BOX_FORMATS}
    tag = F.col(fmt)
    out = {}
    for i, name in enumerate(box):
        value = F.when(tag == BOX_FORMATS[0], converted[BOX_FORMATS[0]][i])
        for source in BOX_FORMATS[1:]:
            value = value.when(tag == source, converted[source][i])
        out[name] = value.otherwise(F.col(name))
    known = tag.isin(*BOX_FORMATS)
    return df.withColumns(
        {
            **out,
            "converted_from": F.when(known & (tag != target), tag),
            fmt: F.when(known, F.lit(target)).otherwise(tag),
        }
    )


def det_filter_confidence(df: DataFrame, threshold: float) -> DataFrame:
    """Detections with a score of at least ``threshold``; rows without a score stay."""
    return df.filter(F.col("score").isNull() | (F.col("score") >= threshold))


def det_filter_class(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.filter(F.col("class_name").isin(*names))


def det_label(name: Column, score: Column) -> Column:
    """``name: 0.87``; only the part that is known."""
    shown = F.format_string("%.2f", score)
    return F.when(name.isNotNull() & score.isNotNull(), F.concat(name, F.lit(": "), shown)).otherwise(
        F.coalesce(name, shown, F.lit(""))
    )


def det_summary(df: DataFrame, *, order: str = "det_id", max_per_row: int | None = None) -> DataFrame:
    """Detections per image as arrays in ``order``: boxes in three formats, ids, names, scores, labels.

    One row per image, part 0. A caller that can work on parts may give ``max_per_row``: an image with more
    detections is then cut by the hash of ``order`` (unique per detection) into parts of about that many.
    """
    cut = df.withColumn("part", F.lit(0).cast("bigint"))
    if max_per_row is not None:
        counts = df.groupBy("image_id").agg(F.ceil(F.count(F.lit(1)) / max_per_row).alias("_parts"))
        cut = join_lookup(df, counts.filter("_parts > 1"), ["image_id"])
        part = F.pmod(F.xxhash64(order), F.coalesce("_parts", F.lit(1)))
        cut = cut.withColumn("part", part.cast("bigint")).drop("_parts")
    packed = cut.groupBy("image_id", "part").agg(F.array_sort(F.collect_list(_item(order))).alias("d"))
    return packed.select("image_id", "part", *_summary("d"))


def det_chunks(df: DataFrame, *, order: str = "det_id", size: int = chunks.SIZE) -> DataFrame:
    """The summary of an image as rows of at most ``size`` detections: image_id, chunk, offset, then as in :func:`det_summary`.

    Detections are in ``order`` over the chunks of an image; one image with a third of all detections lies in many tasks.
    """
    items = df.select("image_id", F.col(order).alias("_order"), _item(order).alias("_item"))
    rows = chunks.ordered_chunks(items, keys=["image_id"], order=["_order"], fields=["_item"], size=size)
    return rows.select("image_id", "chunk", "offset", *_summary("_item"))


def _item(order: str) -> Column:
    corners = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    return F.struct(
        F.col(order).alias("_o"),
        F.array(*corners).alias("xyxy"),
        F.array(*box_convert(corners, "xyxy", "xywh")).alias("xywh"),
        F.array(*box_convert(corners, "xyxy", "ltwh")).alias("ltwh"),
        "class_id",
        "class_name",
        "score",
        det_label(F.col("class_name"), F.col("score")).alias("label"),
    )


def _summary(d: str) -> list[Column]:
    return [
        F.col(f"{d}.xyxy").alias("boxes_xyxy"),
        F.col(f"{d}.xywh").alias("boxes_xywh"),
        F.col(f"{d}.ltwh").alias("boxes_ltwh"),
        F.col(f"{d}.class_id").alias("class_ids"),
        F.col(f"{d}.class_name").alias("class_names"),
        F.col(f"{d}.score").alias("scores"),
        F.col(f"{d}.label").alias("labels"),
        F.size(d).alias("num_predictions"),
        F.lit(False).alias("has_masks"),
        F.struct(F.lit("xyxy").alias("box_format"), F.lit("bgr").alias("color_format")).alias("metadata"),
    ]


def image_reject(height: Column, width: Column, channels: Column, *, low: int = 32, high: int = 8192, required: int = 3) -> Column:
    """Why an image is rejected; null for a usable one."""
    return (
        F.when((height == 0) | (width == 0) | (channels == 0), "empty")
        .when(channels != required, "channels")
        .when((height < low) | (width < low), "too_small")
        .when((height > high) | (width > high), "too_large")
    )


def letterbox(width: Column, height: Column, target_w: int, target_h: int) -> list[Column]:
    """scale, new_w, new_h, x_offset, y_offset of an image fitted into a padded target frame."""
    scale = F.least(target_w / width, target_h / height)
    new_w, new_h = F.floor(width * scale), F.floor(height * scale)
    return [
        scale.alias("scale"),
        new_w.alias("new_w"),
        new_h.alias("new_h"),
        F.floor((target_w - new_w) / 2).alias("x_offset"),
        F.floor((target_h - new_h) / 2).alias("y_offset"),
    ]


def label_from_path(path: Column) -> Column:
    """Parent folder, or the grandparent when the parent is ``images``."""
    parts = F.split(path, "/")
    parent = F.try_element_at(parts, F.lit(-2))
    return F.when(parent == "images", F.try_element_at(parts, F.lit(-3))).otherwise(parent)


def label_from_key(key: Column, prefix: str) -> Column:
    """First part of an object key after its prefix, 'unknown' for a bare file name."""
    parts = F.split(F.trim(F.replace(key, F.lit(prefix), F.lit("")), F.lit("/")), "/")
    return F.when(F.size(parts) > 1, parts[0]).otherwise(F.lit("unknown"))


def frame_indices(total: Column, n: int, *, strategy: str = "uniform", seed: int = 42, key: Column | None = None) -> Column:
    """Frame numbers to read from a video of ``total`` frames, always ``n`` long.

    uniform: evenly spaced, floored; consecutive: from the start; random: a seeded draw without
    repetition in ascending order, by hash of (key, frame, seed). Short videos repeat their last frame;
    a video without frames gives nulls, which stand for blank frames.
    """
    if strategy == "uniform":
        last = (total - 1).cast("double")
        step = last / (n - 1) if n > 1 else F.lit(0.0)
        picked = F.transform(
            F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == n - 1, last if n > 1 else F.lit(0.0)).otherwise(F.floor(i * step)).cast("int")
        )
    elif strategy in ("consecutive", "random"):
        count = F.greatest(F.least(F.lit(n), total), F.lit(1)).cast("int")
        if strategy == "consecutive":
            picked = F.sequence(F.lit(0), count - 1)
        else:
            frames = F.sequence(F.lit(0), F.greatest(total, F.lit(1)).cast("int") - 1)
            of = key if key is not None else F.lit("")
            drawn = F.transform(
                frames, lambda f: F.struct(F.md5(F.concat_ws(":", of.cast("string"), f.cast("string"), F.lit(str(seed)))), f.alias("f"))
            )
            picked = F.array_sort(F.transform(F.slice(F.array_sort(drawn), 1, count), lambda d: d["f"]))
    else:
        raise ValueError("strategy must be uniform, consecutive or random")
    padded = F.concat(picked, F.array_repeat(F.element_at(picked, -1), F.lit(n) - F.size(picked)))
    return F.when(total > 0, padded).otherwise(F.array_repeat(F.lit(None).cast("int"), n))
