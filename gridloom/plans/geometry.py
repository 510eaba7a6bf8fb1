"""Queries over box geometry and scalar expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import boxes, text
from gridloom.plans import fixtures as fx

CENTRE = ("cx", "cy", "w", "h")
KEYS = ("img", "cls", "ord")
CORNERS = ("x1", "y1", "x2", "y2")


def _c(names):
    return tuple(F.col(n) for n in names)


def _named(box, names=CORNERS):
    return [c.alias(n) for c, n in zip(box, names, strict=True)]


def yolo_to_xyxy_norm(spark, sf):
    return fx.unit(spark, sf).select(*KEYS, *_named(boxes.centre_to_corners(*_c(CENTRE))))


def yolo_to_px_extract(spark, sf):
    return fx.unit(spark, sf).select(*KEYS, *_named(boxes.centre_to_pixels(*_c(CENTRE), F.lit(640), F.lit(480), 0.05)))


def yolo_to_px_prompt(spark, sf):
    return fx.unit(spark, sf).select(*KEYS, *_named(boxes.centre_to_pixels(*_c(CENTRE), F.lit(640), F.lit(480), 0.05, inside=True)))


def yolo_to_px_float(spark, sf):
    return fx.unit(spark, sf).select(*KEYS, *_named(boxes.centre_to_float_pixels(*_c(CENTRE), F.lit(640), F.lit(480))))


def ref_box_xywh(spark, sf):
    return fx.unit(spark, sf).select(*KEYS, *_named(boxes.reference_box(*_c(CENTRE), F.lit(640), F.lit(480), 0.01), ("x", "y", "bw", "bh")), *_named(boxes.reference_box(*_c(CENTRE), F.lit(640), F.lit(480)), ("x0", "y0", "bw0", "bh0")))


def xyxy_to_yolo(spark, sf):
    return fx.truths(spark, sf).select(*KEYS, *_named(boxes.corners_to_centre(_c(CORNERS), F.lit(1000), F.lit(1000)), CENTRE))


def norm_to_px(spark, sf):
    return fx.unit(spark, sf).select(*KEYS, *_named(boxes.norm_to_pixels(*_c(CENTRE), F.lit(640), F.lit(480))))


_LAYOUTS = "SELECT p_partkey, CAST(500 + p_size * 10 AS INT) AS size, CAST(p_partkey % 9 + 1 AS DOUBLE) / 10 AS ratio, p_partkey % 2 = 0 AS vertical FROM part"


def canvas_layout(spark, sf):
    rows = fx.select(spark, sf, "", _LAYOUTS, "part")
    return rows.select("p_partkey", *[c.alias(n) for n, c in boxes.canvas_layout(F.col("size"), F.col("ratio"), F.col("vertical")).items()])


def canvas_ref_box(spark, sf):
    lay = boxes.canvas_layout(F.lit(1008), F.lit(0.5), F.lit(True))
    out = boxes.to_canvas(F.col("x1"), F.col("y1"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), (lay["ref_x"], lay["ref_y"]), (lay["ref_w"], lay["ref_h"]), (F.lit(1000), F.lit(1000)), F.lit(1008))
    return fx.truths(spark, sf).select(*KEYS, *_named(out, CENTRE))


def canvas_to_target(spark, sf):
    lay = boxes.canvas_layout(F.lit(1008), F.lit(0.5), F.lit(True))
    out = boxes.from_canvas(_c(CORNERS), (lay["tgt_x"], lay["tgt_y"]), (lay["tgt_w"], lay["tgt_h"]), (F.lit(640), F.lit(480)))
    return fx.preds(spark, sf).withColumn("b", out).select(*KEYS, *[F.col(f"b.{c}").alias(c) for c in CORNERS])


def zero_area(spark, sf):
    px = boxes.centre_to_pixels(F.col("cx"), F.col("cy"), F.col("w") / 40, F.col("h") / 40, F.lit(640), F.lit(480))
    rows = fx.unit(spark, sf).withColumn("empty", boxes.is_empty(px))
    return rows.groupBy("cls").agg(F.count_if("empty").alias("n_skipped"), F.count_if(~F.col("empty")).alias("n_kept"))


def mask_to_bbox(spark, sf):
    mask = "transform(sequence(0, 7), y -> transform(sequence(0, 9), x -> x >= p_partkey % 5 AND x < p_partkey % 5 + p_size % 6 AND y >= p_size % 3 AND y < p_size % 3 + p_partkey % 4))"
    rows = fx.select(spark, sf, "", f"SELECT p_partkey, {mask} AS mask FROM part", "part").withColumn("b", boxes.mask_bounds(F.col("mask")))
    return rows.select("p_partkey", *[F.col(f"b.{c}").cast("long").alias(c) for c in CORNERS])


def combined_score_a(spark, sf):
    return fx.dets(spark, sf).select(*KEYS, boxes.score_a(F.col("score"), F.col("sim")).alias("combined"))


def combined_score_b(spark, sf):
    return fx.dets(spark, sf).select(*KEYS, boxes.score_b(F.col("score"), F.col("sim")).alias("combined"))


def color_bucket(spark, sf):
    return fx.dets(spark, sf).select(*KEYS, boxes.bucket(F.col("score"), 0.15, 0.05).alias("conf_colour"), boxes.bucket(F.col("sim"), 0.65, 0.40).alias("sim_colour"))


def owl_rescale(spark, sf):
    stored, crop = boxes.rescaled(_c(CORNERS), F.lit(0.8), F.lit(700), F.lit(700))
    return fx.preds(spark, sf).where(~boxes.is_empty(crop)).select(*KEYS, *_named(stored), *_named(crop, ("cx1", "cy1", "cx2", "cy2")))


def class_label(spark, sf):
    part = fx.select(spark, sf, "", "SELECT p_partkey, CAST(p_size % 30 AS INT) AS cls FROM part", "part")
    nation = spark.read.parquet(f"{sf}/nation.parquet").where("n_nationkey % 4 <> 3").select(F.col("n_nationkey").alias("cls"), F.col("n_name").alias("name"))
    return part.join(nation, "cls", "left").select("p_partkey", text.class_label(F.col("cls"), F.col("name")).alias("label"), text.class_colour(F.col("cls")).alias("colour"))


def class_choices(spark, sf):
    nation = spark.read.parquet(f"{sf}/nation.parquet")
    choice = F.concat(F.col("n_nationkey").cast("string"), F.lit(": "), F.col("n_name"))
    return nation.select(choice.alias("choice"), F.split_part(choice, F.lit(":"), F.lit(1)).cast("int").alias("cls"))


def log_filter(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.posexplode(text.log_lines(F.col("text"))).alias("line_no", "line"))
    part = spark.read.parquet(f"{sf}/part.parquet")
    made = part.select(F.col("p_partkey").alias("doc_id"), F.lit(-1).alias("line_no"), F.concat(F.element_at(F.array(*[F.lit(x) for x in ("", "[run] ", "  ", "✅ ", " Done ")]), (F.col("p_partkey") % 5 + 1).cast("int")), F.lit("40%|####| 2/5 it/s"), F.col("p_name")).alias("line"))
    both = rows.unionByName(made).withColumn("drop", text.is_progress_line(F.col("line")))
    return both.groupBy("doc_id").agg(F.count_if("drop").alias("n_dropped"), F.count_if(~F.col("drop")).alias("n_shown"))


def crop_name(spark, sf):
    stem = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("a_cls1_b"), F.col("p_partkey"))).otherwise(F.regexp_replace("p_name", " ", "_"))
    rows = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.when(F.col("p_partkey") % 7 == 0, F.lit("plain")).otherwise(text.crop_name(stem, F.col("p_size"), F.col("p_partkey"))).alias("name"))
    return rows.select("p_partkey", "name", text.crop_part(F.col("name"), 1).alias("stem"), text.crop_part(F.col("name"), 2).cast("int").alias("cls"), text.crop_part(F.col("name"), 3).cast("int").alias("idx"))


def content_ratio(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.explode("embedding").alias("v"))
    ratio = rows.groupBy("vec_id").agg(F.avg((F.col("v").cast("double") > 0.05).cast("double")).alias("ratio"))
    return ratio.where(F.col("ratio") >= 0.3).orderBy("vec_id").limit(30)


_KEYS = "img, cls, ord"


def _unit(cols: str) -> str:
    return f"WITH {fx.UNIT} SELECT {_KEYS}, {cols} FROM unit"


def _px(edge: int) -> str:
    p = "0.05::DOUBLE"
    return _unit(
        f"greatest(0, CAST(trunc((cx - w / 2 - w * {p}) * 640) AS INT)) AS x1, greatest(0, CAST(trunc((cy - h / 2 - h * {p}) * 480) AS INT)) AS y1, "
        f"least({640 - edge}, CAST(trunc((cx + w / 2 + w * {p}) * 640) AS INT)) AS x2, least({480 - edge}, CAST(trunc((cy + h / 2 + h * {p}) * 480) AS INT)) AS y2"
    )


ORACLES = {
    "yolo_to_xyxy_norm": _unit("cx - w / 2 AS x1, cy - h / 2 AS y1, cx + w / 2 AS x2, cy + h / 2 AS y2"),
    "yolo_to_px_extract": _px(0),
    "yolo_to_px_prompt": _px(1),
    "yolo_to_px_float": _unit("greatest(0.0::DOUBLE, (cx - w / 2) * 640) AS x1, greatest(0.0::DOUBLE, (cy - h / 2) * 480) AS y1, least(640.0::DOUBLE, (cx + w / 2) * 640) AS x2, least(480.0::DOUBLE, (cy + h / 2) * 480) AS y2"),
    "ref_box_xywh": f"""WITH {fx.UNIT}, p AS (SELECT *, (cx - w / 2) * 640 AS x0, (cy - h / 2) * 480 AS y0, w * 640 AS bw0, h * 480 AS bh0 FROM unit),
        c AS (SELECT *, greatest(0.0::DOUBLE, x0 - bw0 * 0.01::DOUBLE) AS x, greatest(0.0::DOUBLE, y0 - bh0 * 0.01::DOUBLE) AS y,
              least(640.0::DOUBLE, x0 + bw0 + bw0 * 0.01::DOUBLE) AS xx, least(480.0::DOUBLE, y0 + bh0 + bh0 * 0.01::DOUBLE) AS yy FROM p)
        SELECT {_KEYS}, x, y, xx - x AS bw, yy - y AS bh, x0, y0, bw0, bh0 FROM c""",
    "xyxy_to_yolo": f"WITH {fx.BOX} SELECT {_KEYS}, (x1 + x2) / 2 / 1000 AS cx, (y1 + y2) / 2 / 1000 AS cy, (x2 - x1) / 1000 AS w, (y2 - y1) / 1000 AS h FROM gt",
    "norm_to_px": _unit("(cx - w / 2) * 640 AS x1, (cy - h / 2) * 480 AS y1, (cx + w / 2) * 640 AS x2, (cy + h / 2) * 480 AS y2"),
    "canvas_layout": f"""WITH l AS ({_LAYOUTS}), s AS (SELECT *, CAST(trunc(size * ratio) AS INT) AS cut FROM l)
        SELECT p_partkey, 0 AS ref_x, 0 AS ref_y, CASE WHEN vertical THEN size ELSE cut END AS ref_w, CASE WHEN vertical THEN cut ELSE size END AS ref_h,
        CASE WHEN vertical THEN 0 ELSE cut END AS tgt_x, CASE WHEN vertical THEN cut ELSE 0 END AS tgt_y,
        CASE WHEN vertical THEN size ELSE size - cut END AS tgt_w, CASE WHEN vertical THEN size - cut ELSE size END AS tgt_h FROM s""",
    "canvas_ref_box": f"""WITH {fx.BOX}, s AS (SELECT *, 1008.0::DOUBLE / 1000 AS sx, 504.0::DOUBLE / 1000 AS sy FROM gt)
        SELECT {_KEYS}, (x1 * sx + 0 + (x2 - x1) * sx / 2) / 1008 AS cx, (y1 * sy + 0 + (y2 - y1) * sy / 2) / 1008 AS cy, (x2 - x1) * sx / 1008 AS w, (y2 - y1) * sy / 1008 AS h FROM s""",
    "canvas_to_target": f"""WITH {fx.BOX}, c AS (SELECT {_KEYS}, greatest(x1, 0.0::DOUBLE) AS a, least(x2, 1008.0::DOUBLE) AS c, greatest(y1, 504.0::DOUBLE) AS b, least(y2, 1008.0::DOUBLE) AS d FROM pred)
        SELECT {_KEYS}, CASE WHEN c > a AND d > b THEN (a - 0) * (640.0::DOUBLE / 1008) END AS x1, CASE WHEN c > a AND d > b THEN (b - 504) * (480.0::DOUBLE / 504) END AS y1,
        CASE WHEN c > a AND d > b THEN (c - 0) * (640.0::DOUBLE / 1008) END AS x2, CASE WHEN c > a AND d > b THEN (d - 504) * (480.0::DOUBLE / 504) END AS y2 FROM c""",
    "zero_area": f"""WITH {fx.UNIT}, s AS (SELECT cls, cx, cy, w / 40 AS w, h / 40 AS h FROM unit), p AS (SELECT cls,
        least(640, trunc((cx + w / 2) * 640)) <= greatest(0, trunc((cx - w / 2) * 640)) OR least(480, trunc((cy + h / 2) * 480)) <= greatest(0, trunc((cy - h / 2) * 480)) AS empty FROM s)
        SELECT cls, count(*) FILTER (WHERE empty) AS n_skipped, count(*) FILTER (WHERE NOT empty) AS n_kept FROM p GROUP BY cls""",
    "mask_to_bbox": """WITH b AS (SELECT p_partkey, p_partkey % 5 AS x, p_size % 6 AS w, p_size % 3 AS y, p_partkey % 4 AS h FROM part)
        SELECT p_partkey, CASE WHEN w > 0 AND h > 0 THEN x END AS x1, CASE WHEN w > 0 AND h > 0 THEN y END AS y1,
        CASE WHEN w > 0 AND h > 0 THEN least(x + w - 1, 9) END AS x2, CASE WHEN w > 0 AND h > 0 THEN least(y + h - 1, 7) END AS y2 FROM b""",
    "combined_score_a": f"WITH {fx.DETS} SELECT {_KEYS}, 0.3::DOUBLE * score + 0.7::DOUBLE * sim AS combined FROM dets",
    "combined_score_b": f"WITH {fx.DETS} SELECT {_KEYS}, 0.2::DOUBLE * score + 0.8::DOUBLE * sim AS combined FROM dets",
    "color_bucket": f"""WITH {fx.DETS} SELECT {_KEYS}, CASE WHEN score >= 0.15::DOUBLE THEN 'lime' WHEN score >= 0.05::DOUBLE THEN 'yellow' ELSE 'red' END AS conf_colour,
        CASE WHEN sim >= 0.65::DOUBLE THEN 'lime' WHEN sim >= 0.40::DOUBLE THEN 'yellow' ELSE 'red' END AS sim_colour FROM dets""",
    "owl_rescale": f"""WITH {fx.BOX}, s AS (SELECT {_KEYS}, x1 / 0.8::DOUBLE AS a, y1 / 0.8::DOUBLE AS b, x2 / 0.8::DOUBLE AS c, y2 / 0.8::DOUBLE AS d FROM pred),
        p AS (SELECT *, greatest(0, CAST(trunc(a - (c - a) * 0.1::DOUBLE) AS INT)) AS cx1, greatest(0, CAST(trunc(b - (d - b) * 0.1::DOUBLE) AS INT)) AS cy1,
        least(700, CAST(trunc(c + (c - a) * 0.1::DOUBLE) AS INT)) AS cx2, least(700, CAST(trunc(d + (d - b) * 0.1::DOUBLE) AS INT)) AS cy2 FROM s)
        SELECT {_KEYS}, round(a, 1) AS x1, round(b, 1) AS y1, round(c, 1) AS x2, round(d, 1) AS y2, cx1, cy1, cx2, cy2 FROM p WHERE cx2 > cx1 AND cy2 > cy1""",
    "class_label": f"""SELECT p_partkey, coalesce(n_name, 'cls' || CAST(p_size % 30 AS VARCHAR)) AS label, list_extract({text.CLASS_COLOURS!r}, CAST(p_size % 30 % 10 + 1 AS INT)) AS colour
        FROM part LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 4 <> 3) n ON n_nationkey = p_size % 30""",
    "class_choices": "SELECT CAST(n_nationkey AS VARCHAR) || ': ' || n_name AS choice, n_nationkey AS cls FROM nation",
    "log_filter": r"""WITH l AS (
          SELECT doc_id, unnest(regexp_split_to_array(text, '\r\n|\r|\n')) AS line FROM documents
          UNION ALL SELECT p_partkey, ['', '[run] ', '  ', '✅ ', ' Done '][CAST(p_partkey % 5 + 1 AS INT)] || '40%|####| 2/5 it/s' || p_name FROM part),
        s AS (SELECT doc_id, trim(line, ' ') AS s FROM l),
        d AS (SELECT doc_id, contains(s, '|') AND regexp_matches(s, '%|it/s|s/it|frame/s|img/s|batch|prop') AND NOT regexp_matches(s, '^(\[|=|✅|❌|⚠)') AS drop FROM s)
        SELECT doc_id, count(*) FILTER (WHERE drop) AS n_dropped, count(*) FILTER (WHERE NOT drop) AS n_shown FROM d GROUP BY doc_id""",
    "crop_name": r"""WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'plain' ELSE CASE WHEN p_partkey % 3 = 0 THEN 'a_cls1_b' || CAST(p_partkey AS VARCHAR) ELSE replace(p_name, ' ', '_') END
          || '_cls' || CAST(p_size AS VARCHAR) || '_' || CAST(p_partkey AS VARCHAR) END AS name FROM part)
        SELECT p_partkey, name, nullif(regexp_extract(name, '^(.+)_cls(\d+)_(\d+)$', 1), '') AS stem, TRY_CAST(regexp_extract(name, '^(.+)_cls(\d+)_(\d+)$', 2) AS INT) AS cls,
        TRY_CAST(regexp_extract(name, '^(.+)_cls(\d+)_(\d+)$', 3) AS INT) AS idx FROM n""",
    "content_ratio": """WITH r AS (SELECT vec_id, avg(CASE WHEN CAST(v AS DOUBLE) > 0.05::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS ratio FROM (SELECT vec_id, unnest(embedding) AS v FROM embeddings) GROUP BY vec_id)
        SELECT vec_id, ratio FROM r WHERE ratio >= 0.3::DOUBLE ORDER BY vec_id LIMIT 30""",
}
QUERIES = {n: globals()[n] for n in ORACLES}
