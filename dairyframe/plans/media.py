"""Detections and media metadata over embeddings and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from dairyframe import datasets as ds
from dairyframe.operators import detections as dt
from dairyframe.plans import query


def _corners():
    return [F.col(c) for c in ("x1", "y1", "x2", "y2")]


@query(
    "box_convert",
    ds.with_views(
        "detections",
        """SELECT det_id, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, x2 - x1 AS w, y2 - y1 AS h,
                  x1 AS back_x1, y1 AS back_y1, x1 + (x2 - x1) AS back_x2, y1 + (y2 - y1) AS back_y2 FROM detections""",
    ),
)
def convert(spark, sf_dir):
    centre = [c.alias(n) for c, n in zip(dt.box_convert(_corners(), "xyxy", "xywh"), ("cx", "cy", "w", "h"))]
    left_top = dt.box_convert(_corners(), "xyxy", "ltwh")
    back = dt.box_convert(left_top, "ltwh", "xyxy")
    names = ("back_x1", "back_y1", "back_x2", "back_y2")
    return ds.detections(spark, sf_dir).select("det_id", *centre, *[c.alias(n) for c, n in zip(back, names)])


@query(
    "box_standardize",
    ds.with_views(
        "detections",
        """SELECT det_id, CASE tag WHEN 0 THEN x1 WHEN 1 THEN x1 - x2 / 2 WHEN 2 THEN x1 ELSE x1 END AS p,
                  CASE tag WHEN 1 THEN y1 - y2 / 2 ELSE y1 END AS q,
                  CASE tag WHEN 1 THEN x1 + x2 / 2 WHEN 2 THEN x1 + x2 ELSE x2 END AS r,
                  CASE tag WHEN 1 THEN y1 + y2 / 2 WHEN 2 THEN y1 + y2 ELSE y2 END AS s,
                  CASE WHEN tag = 3 THEN NULL ELSE 'xyxy' END AS box_format,
                  CASE tag WHEN 1 THEN 'xywh' WHEN 2 THEN 'ltwh' END AS converted_from
           FROM (SELECT *, det_id % 4 AS tag FROM detections)""",
    ),
)
def standardize(spark, sf_dir):
    tag = F.col("det_id") % 4
    rows = ds.detections(spark, sf_dir).select(
        "det_id",
        F.col("x1").alias("p"),
        F.col("y1").alias("q"),
        F.col("x2").alias("r"),
        F.col("y2").alias("s"),
        F.when(tag == 0, "xyxy").when(tag == 1, "xywh").when(tag == 2, "ltwh").alias("box_format"),
    )
    return dt.box_standardize(rows, "xyxy")


@query("det_filter_confidence", ds.with_views("detections", "SELECT det_id, score FROM detections WHERE score >= 0.1 OR score IS NULL"))
def confidence(spark, sf_dir):
    return dt.det_filter_confidence(ds.detections(spark, sf_dir), 0.1).select("det_id", "score")


@query("det_filter_class", ds.with_views("detections", "SELECT det_id, class_name FROM detections WHERE class_name IN ('c1', 'c4')"))
def classes(spark, sf_dir):
    return dt.det_filter_class(ds.detections(spark, sf_dir), ["c1", "c4"]).select("det_id", "class_name")


@query(
    "det_summary",
    ds.with_views(
        "detections",
        """SELECT image_id, 0::BIGINT AS part, CAST(count(*) AS INTEGER) AS num_predictions,
                  string_agg(class_name, ',' ORDER BY det_id) AS class_names,
                  round(sum(x1 + 2 * y1 + 3 * x2 + 4 * y2), 3) AS corner_sum, round(sum(x2 - x1), 3) AS width_sum, count(score) AS scored
           FROM detections GROUP BY 1""",
    ),
)
def summary(spark, sf_dir):
    out = dt.det_summary(ds.detections(spark, sf_dir))

    def total(values):
        return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)

    corners = F.transform("boxes_xyxy", lambda b: b[0] + 2 * b[1] + 3 * b[2] + 4 * b[3])
    return out.select(
        "image_id",
        "part",
        "num_predictions",
        F.array_join("class_names", ",").alias("class_names"),
        F.round(total(corners), 3).alias("corner_sum"),
        F.round(total(F.transform("boxes_xywh", lambda b: b[2])), 3).alias("width_sum"),
        F.size(F.filter("scores", lambda v: v.isNotNull())).cast("bigint").alias("scored"),
    )


@query(
    "det_chunks",
    ds.with_views(
        "detections",
        """SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY det_id) - 1 AS slot, class_name, score, x2 - x1 AS width FROM detections""",
    ),
)
def chunked(spark, sf_dir):
    rows = dt.det_chunks(ds.detections(spark, sf_dir), size=4)
    zipped = F.arrays_zip("class_names", "scores", "boxes_xywh")
    laid = rows.select("image_id", "offset", F.posexplode(zipped).alias("at", "r"))
    return laid.select(
        "image_id", (F.col("offset") + F.col("at")).alias("slot"), F.col("r.class_names").alias("class_name"), F.col("r.scores").alias("score"), F.col("r.boxes_xywh")[2].alias("width")
    )


@query(
    "det_label",
    ds.with_views(
        "detections",
        """SELECT det_id, class_name || CASE WHEN score IS NOT NULL THEN ': ' || printf('%.2f', q / 100.0) ELSE '' END AS label
           FROM (SELECT *, floor(score * 100 + 0.5) AS q FROM detections)""",
    ),
)
def label(spark, sf_dir):
    # scores are cut to two decimals first, so that both sides print the same number
    score = F.floor(F.col("score") * 100 + 0.5) / 100
    return ds.detections(spark, sf_dir).select("det_id", dt.det_label(F.col("class_name"), score).alias("label"))


@query(
    "image_size_check",
    """SELECT page_id, CASE WHEN h = 0 OR w = 0 OR c = 0 THEN 'empty' WHEN c <> 3 THEN 'channels' WHEN h < 32 OR w < 32 THEN 'too_small'
              WHEN h > 8192 OR w > 8192 THEN 'too_large' END AS reason
       FROM (SELECT page_id, length(html) % 9000 AS h, length(url) * 7 % 500 AS w, 1 + page_id % 4 AS c FROM pages)""",
)
def image_size(spark, sf_dir):
    rows = ds.table(spark, sf_dir, "pages").select(
        "page_id", (F.length("html") % 9000).alias("h"), (F.length("url") * 7 % 500).alias("w"), (1 + F.col("page_id") % 4).alias("c")
    )
    return rows.select("page_id", dt.image_reject(F.col("h"), F.col("w"), F.col("c")).alias("reason"))


@query(
    "letterbox_geometry",
    """SELECT page_id, scale, CAST(nw AS BIGINT) AS new_w, CAST(nh AS BIGINT) AS new_h, CAST(floor((640 - nw) / 2) AS BIGINT) AS x_offset,
              CAST(floor((480 - nh) / 2) AS BIGINT) AS y_offset
       FROM (SELECT page_id, scale, floor(w * scale) AS nw, floor(h * scale) AS nh
             FROM (SELECT page_id, w, h, least(640 / w, 480 / h) AS scale
                   FROM (SELECT page_id, 1 + length(html) AS h, 100 + length(url) * 7 AS w FROM pages)))""",
)
def letterbox(spark, sf_dir):
    rows = ds.table(spark, sf_dir, "pages").select(
        "page_id", (1 + F.length("html")).alias("h"), (100 + F.length("url") * 7).alias("w")
    )
    return rows.select("page_id", *dt.letterbox(F.col("w"), F.col("h"), 640, 480))


PATH_SQL = "CASE page_id % 3 WHEN 0 THEN url || '/images/f.jpg' WHEN 1 THEN url || '/f.jpg' ELSE 'f' || page_id || '.jpg' END"


def _path():
    page = F.col("page_id")
    return (
        F.when(page % 3 == 0, F.concat("url", F.lit("/images/f.jpg")))
        .when(page % 3 == 1, F.concat("url", F.lit("/f.jpg")))
        .otherwise(F.concat(F.lit("f"), page.cast("string"), F.lit(".jpg")))
    )


@query(
    "label_from_path",
    f"""SELECT page_id, CASE WHEN p[-2] = 'images' THEN p[-3] ELSE p[-2] END AS folder,
               CASE WHEN len(k) > 1 THEN k[1] ELSE 'unknown' END AS object_label
        FROM (SELECT page_id, string_split(path, '/') AS p, string_split(trim(replace(path, 'https://', ''), '/'), '/') AS k
              FROM (SELECT page_id, {PATH_SQL} AS path FROM pages))""",
)
def path_label(spark, sf_dir):
    return ds.table(spark, sf_dir, "pages").select(
        "page_id", dt.label_from_path(_path()).alias("folder"), dt.label_from_key(_path(), "https://").alias("object_label")
    )


@query(
    "frame_indices",
    """SELECT page_id, i AS slot, CASE WHEN t > 0 THEN CAST(CASE WHEN i = 7 THEN t - 1 ELSE floor(i * ((t - 1)::DOUBLE / 7)) END AS INTEGER) END AS uniform,
              CASE WHEN t > 0 THEN CAST(least(i, t - 1) AS INTEGER) END AS consecutive
       FROM (SELECT page_id, length(html) % 40 AS t FROM pages) CROSS JOIN (SELECT CAST(unnest(range(0, 8)) AS INTEGER) AS i)""",
)
def frames(spark, sf_dir):
    total = F.length("html") % 40
    both = F.arrays_zip(
        dt.frame_indices(total, 8).alias("uniform"), dt.frame_indices(total, 8, strategy="consecutive").alias("consecutive")
    )
    rows = ds.table(spark, sf_dir, "pages").select("page_id", F.posexplode(both).alias("slot", "f"))
    return rows.select("page_id", "slot", "f.uniform", "f.consecutive")


@query(
    "frame_indices_random",
    """SELECT page_id, count(*) AS n, sum(f)::BIGINT AS frame_sum
       FROM (SELECT page_id, f, row_number() OVER (PARTITION BY page_id ORDER BY md5(page_id || ':' || f || ':42')) AS rk
             FROM (SELECT page_id, unnest(range(0, 10 + length(html) % 40)) AS f FROM pages)) WHERE rk <= 8 GROUP BY 1""",
)
def frames_random(spark, sf_dir):
    total = 10 + F.length("html") % 40
    picked = dt.frame_indices(total, 8, strategy="random", key=F.col("page_id"))
    rows = ds.table(spark, sf_dir, "pages").select("page_id", F.explode(picked).alias("f"))
    return rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.sum("f").alias("frame_sum"))
