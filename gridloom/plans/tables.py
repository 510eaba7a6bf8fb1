"""Queries over label text, JSON summaries, joins and vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.functions import vectors
from gridloom.operators import aggregates, joins
from gridloom.plans import fixtures as fx
from gridloom.sources import labels, summary, writers

NUMBERS = ("cls", "cx", "cy", "w", "h")


def parse_labels(spark, sf):
    return labels.parse(fx.lines(spark, sf), strict=True)


def parse_labels_lenient(spark, sf):
    return labels.parse(fx.lines(spark, sf, bad=True), strict=False)


def ann_index(spark, sf):
    return labels.indexed(parse_labels_lenient(spark, sf), [0, 2]).select("stem", "line_no", "cls", "ann_idx")


def discover_classes(spark, sf):
    return labels.discover_classes(fx.lines(spark, sf, bad=True))


def class_names(spark, sf):
    return labels.class_names(fx.names(spark, sf))


def class_filter(spark, sf):
    wanted = labels.class_names(fx.names(spark, sf)).where("name LIKE '%A%'").select("cls")
    return parse_labels(spark, sf).join(wanted, "cls", "left_semi").select("stem", "line_no", "cls")


def stride_sample(spark, sf):
    paths = spark.read.parquet(f"{sf}/part.parquet").select(F.concat_ws("/", F.lit("images"), F.lpad(F.col("p_partkey").cast("string"), 7, "0")).alias("path"))
    return labels.stride(paths, 3)


def odd_lines(spark, sf):
    """Fields of lines with tabs, form feeds and line separators at their ends."""
    out = fx.lines(spark, sf).select("stem", "line_no", F.size(labels.parts(F.col("line"))).alias("n"))
    return out.groupBy("n").agg(F.count(F.lit(1)).alias("lines"))


def _images(spark, sf):
    """Images of the stems: those of every ninth are missing, every fourth is there with two extensions."""
    stems = fx.lines(spark, sf).select("stem").distinct().where("CAST(stem AS BIGINT) % 9 <> 4")
    ext = F.when(F.col("stem").cast("long") % 4 == 0, F.array(F.lit("png"), F.lit("jpg"))).otherwise(F.array(F.lit("png")))
    return stems.select("stem", F.explode(ext).alias("ext")).withColumn("path", F.concat("stem", F.lit("."), "ext"))


_IMAGES = """, stems AS (SELECT DISTINCT stem FROM lines), images AS (
  SELECT stem, ext, stem || '.' || ext AS path FROM (SELECT stem, unnest(CASE WHEN CAST(stem AS BIGINT) % 4 = 0 THEN ['png', 'jpg'] ELSE ['png'] END) AS ext FROM stems WHERE CAST(stem AS BIGINT) % 9 <> 4))"""


def resolve_source(spark, sf):
    return joins.resolve(fx.lines(spark, sf).select("stem").distinct(), _images(spark, sf))


def source_groups(spark, sf):
    crops = parse_labels(spark, sf).select("cls", "stem", F.format_string("%s_cls%d_%d", "stem", "cls", "line_no").alias("name"))
    return labels.source_groups(crops, _images(spark, sf)).select("cls", "stem", F.array_join("crops", ",").alias("crops"), "path")


def join_image_label(spark, sf):
    return parse_labels(spark, sf).join(_images(spark, sf).where("ext = 'png'"), "stem").select("stem", "path", "line_no", "cls")


def eval_stems(spark, sf):
    """Stems of the images; where there is no image folder, those of the label files without previews and summaries."""
    files = spark.read.parquet(f"{sf}/part.parquet").select(F.when(F.col("p_partkey") % 5 == 0, F.concat(F.col("p_partkey"), F.lit("_preview"))).when(F.col("p_partkey") == 7, "summary").otherwise(F.col("p_partkey").cast("string")).alias("stem"))
    return joins.eval_stems(_images(spark, sf), files).select(F.lit("images").alias("source"), "stem").union(joins.eval_stems(None, files).select(F.lit("files").alias("source"), "stem"))


def eval_left_join(spark, sf):
    stems = fx.lines(spark, sf).select("stem").distinct()
    n = lambda df, name: df.select(F.col("img").cast("string").alias("stem")).groupBy("stem").agg(F.count(F.lit(1)).alias(name))
    pred = n(fx.preds(spark, sf).where("score >= 0.9 AND cls = 1"), "n_pred")
    gt = n(fx.truths(spark, sf).where("cls = 1"), "n_gt")
    return stems.join(pred, "stem", "left").join(gt, "stem", "left").na.fill(0, ["n_pred", "n_gt"])


def local_class_map(spark, sf):
    return joins.local_classes(parse_labels(spark, sf).where("cls <> CAST(stem AS BIGINT) % 3"))


def pair_plan(spark, sf):
    sources = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_name").alias("src"))
    return joins.pair_plan(sources, _images(spark, sf).where("ext = 'png'").select("stem"))


def zip_scores(spark, sf):
    boxed = fx.preds(spark, sf).groupBy("img", "cls").agg(F.sort_array(F.collect_list("ord")).alias("boxes"))
    scores = fx.preds(spark, sf).where("img % 60 <> 0 OR ord > 3").groupBy("img", "cls").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "score"))), lambda x: x["score"]).alias("scores"))
    out = joins.zip_scores(boxed, scores, ["img", "cls"])
    return out.select("img", "cls", F.round(F.aggregate("scores", F.lit(0.0), lambda s, x: s + x), 6).alias("score_sum"), F.size("scores").alias("n"))


def yolo_lines(spark, sf):
    dets = fx.preds(spark, sf).withColumn("stem", F.col("img").cast("string")).where("score >= 0.5 AND img % 100 <> 40")
    stems = fx.preds(spark, sf).select(F.col("img").cast("string").alias("stem")).distinct()
    return writers.label_files(dets, stems, 512.0, 640.0)


def yolo_lines_b(spark, sf):
    dets = fx.preds(spark, sf).withColumn("stem", F.col("img").cast("string")).where("score >= 0.5 AND img % 100 <> 40")
    stems = fx.preds(spark, sf).select(F.col("img").cast("string").alias("stem")).distinct()
    return writers.label_files(dets, stems, 1000.0, 1000.0, final_newline=True)


def _summary_a(spark, sf):
    preds = fx.preds(spark, sf).withColumn("file", F.concat(F.lit("shots/"), F.col("img"), F.lit(".jpg")))
    counts = preds.groupBy("file", "cls").agg(F.count(F.lit(1)).cast("int").alias("n_proposals"), F.count_if(F.col("score") >= 0.1).cast("int").alias("n_wbf"))
    return summary.build_a(preds.where("score >= 0.5").select("file", "cls", "ord", "x1", "y1", "x2", "y2", "score"), counts)


def _summary_b(spark, sf):
    dets = fx.dets(spark, sf).withColumn("file", F.concat(F.col("img"), F.lit(".v2.png"))).withColumn("combined", F.col("sim"))
    return summary.build_b(dets.select("file", "cls", "ord", "x1", "y1", "x2", "y2", "score", "sim", "combined"))


def summary_json_a(spark, sf):
    """The documents of shape A, read back: totals and counts by image and class."""
    rows = summary.parse(_summary_a(spark, sf)).select("stem", "info.label_file", "info.n_final_total", F.explode("info.classes").alias("cls", "c"))
    return rows.select("stem", "label_file", "n_final_total", "cls", "c.n_proposals", "c.n_wbf", "c.n_final", F.aggregate("c.boxes", F.lit(0.0), lambda s, b: s + b["xyxy"][0]).alias("x1_sum"))


def summary_json_b(spark, sf):
    rows = summary.parse(_summary_b(spark, sf)).select("file", "info.label_file", "info.n_final_total", F.posexplode("info.boxes").alias("pos", "b"))
    return rows.select("file", "label_file", "n_final_total", "pos", "b.class_id", F.element_at("b.box", 3).alias("x2"), "b.sam3_score", "b.dino_sim", "b.combined_score")


def summary_scores(spark, sf):
    entries = summary.parse(_summary_a(spark, sf)).unionByName(summary.parse(_summary_b(spark, sf)))
    return summary.scores(entries)


def _entries(spark, sf):
    text = "SELECT to_json(map(concat('img', p_partkey, '.jpg'), named_struct('label_file', concat('img', p_partkey, '.txt'), 'preview_file', CASE WHEN p_partkey % 3 > 0 THEN concat('p/img', p_partkey, '.png') END, 'n_final_total', CASE WHEN p_partkey % 4 > 0 THEN p_size END))) AS json FROM part"
    return summary.parse(fx.select(spark, sf, "", text, "part"))


def gallery(spark, sf):
    return summary.gallery(_entries(spark, sf))


def export_counts(spark, sf):
    files = spark.read.parquet(f"{sf}/part.parquet").where("p_partkey % 7 <> 0").select(F.concat(F.lit("img"), F.col("p_partkey"), F.lit(".txt")).alias("path"))
    return summary.export_counts(_entries(spark, sf), files)


def max_sim(spark, sf):
    out = joins.max_similarity(fx.proposals(spark, sf), fx.bank(spark, sf))
    return out.select("cls", "id", F.round("sim", 6).alias("sim"), "best_ref")


def sim_gate(spark, sf):
    return joins.max_similarity(fx.proposals(spark, sf), fx.bank(spark, sf)).where(F.col("sim") >= 0.2).select("cls", "id")


def missing_bank(spark, sf):
    props, bank = fx.proposals(spark, sf), fx.bank(spark, sf)
    return props.join(bank.select("cls").distinct(), "cls", "left_anti").select("cls", "id")


def empty_banks(spark, sf):
    """Classes without reference crops, and the proposals that remain."""
    kept, skipped = joins.with_bank(fx.proposals(spark, sf), fx.bank(spark, sf))
    return skipped.select("cls", F.lit(0).cast("long").alias("n")).union(kept.groupBy("cls").agg(F.count(F.lit(1)).alias("n")))


def source_sim_filter(spark, sf):
    """Vectors whose scene, one vector for each hundred, is similar enough to the target scene (vector 0)."""
    v = fx.vectors(spark, sf)
    scenes = v.where("id % 100 = 7").select((F.floor(F.col("id") / 100)).alias("scene"), "emb")
    target = v.where("id = 0").select("emb")
    return joins.near_scenes(v.withColumn("scene", F.floor(F.col("id") / 100)), scenes, target, 0.0).select("id")


def cosine(spark, sf):
    """Each vector with the mean of its class: all vectors, one row each."""
    pairs = fx.vectors(spark, sf).join(aggregates.centroid(fx.vectors(spark, sf)), "cls")
    return pairs.select("id", F.round(vectors.dot(F.col("emb"), F.col("centroid")), 6).alias("cosine"), F.round(vectors.euclid(F.col("emb"), F.col("centroid")), 6).alias("euclid"))


def l2_normalize(spark, sf):
    v = fx.vectors(spark, sf).select("id", F.transform("emb", lambda x, i: x.cast("double") * (i + 1)).alias("emb"))
    return v.select("id", F.posexplode(vectors.normalised(F.col("emb"))).alias("i", "v")).select("id", "i", F.round("v", 9).alias("v"))


def centroid(spark, sf):
    out = aggregates.centroid(fx.vectors(spark, sf))
    return out.select("cls", F.posexplode("centroid").alias("i", "v")).select("cls", "i", F.round("v", 9).alias("v"))


def masked_pool(spark, sf):
    v = fx.vectors(spark, sf)
    tokens = v.select(F.floor(F.col("id") / 10).alias("crop"), (F.col("id") % 10).alias("token"), (F.col("id") % 10 == 0).alias("is_cls"), ((F.col("id") % 7 < 3) & (F.floor(F.col("id") / 10) % 4 > 0)).alias("masked"), "emb")
    return aggregates.masked_pool(tokens).select("crop", "i", F.round("v", 9).alias("v"))


def pooled_all(spark, sf):
    """All tokens' mean of crops without a mask and for a class of small objects, brought to length 1."""
    v = fx.vectors(spark, sf).withColumn("crop", F.floor(F.col("id") / 10))
    tokens = v.select("crop", (F.col("id") % 10 == 0).alias("is_cls"), F.when(F.col("crop") % 2 == 0, F.col("id") % 7 < 3).alias("masked"), "emb")
    rows = aggregates.masked_pool(tokens, unit=True).select(F.lit("mask").alias("mode"), "*").union(aggregates.masked_pool(tokens, every=True, unit=True).select(F.lit("all").alias("mode"), "*"))
    return rows.select("mode", "crop", "i", F.round("v", 9).alias("v"))


def exemplar_prefix(spark, sf):
    own = fx.bank(spark, sf).groupBy("cls").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "ref_name"))), lambda x: x["ref_name"]).alias("refs"))
    return own.select("cls", F.array_join(F.slice("refs", 1, 5), ",").alias("refs"))


def best_mask(spark, sf):
    rows = fx.preds(spark, sf).groupBy("img", "cls").agg(F.max(F.struct("score", (-F.col("ord")).alias("o"))).alias("m"))
    return rows.select("img", "cls", (-F.col("m.o")).alias("best"), F.col("m.score").alias("score"))


def mask_quality(spark, sf):
    rows = fx.select(spark, sf, "", "SELECT p_partkey, p_size * 3 AS mask_area, p_partkey % 400 AS bbox_area, CAST(p_partkey % 100 AS DOUBLE) / 100 AS sam_score FROM part", "part")
    return joins.good_masks(rows, 0.5, 0.1).select("p_partkey")


def set_ops(spark, sf):
    rows = parse_labels(spark, sf)
    one, two = rows.where("w < 0.04").select("stem", "cls"), rows.where("h < 0.03").select("stem", "cls")
    tagged = lambda df, t: df.select(F.lit(t).alias("op"), "*")
    every = tagged(one.union(two).distinct(), "union").union(tagged(one.intersect(two), "intersect")).union(tagged(one.subtract(two), "except"))
    return every.groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.sum("cls").alias("cls_sum"))


def class_rank(spark, sf):
    """Classes of an image by their number of boxes, the two largest."""
    counts = fx.truths(spark, sf).groupBy("img", "cls").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("img").orderBy(F.col("n").desc(), "cls"))
    return counts.withColumn("r", rank).where("r <= 2")


_SPLIT = r"list_filter(regexp_split_to_array(line, '[\t\n\v\f\r ]+'), lambda x: x <> '')"
_PARSED = rf"""p AS (SELECT stem, line_no, {_SPLIT} AS t FROM {{source}}),
parsed AS (SELECT stem, line_no, CAST(t[1] AS INT) AS cls, CAST(t[2] AS DOUBLE) AS cx, CAST(t[3] AS DOUBLE) AS cy, CAST(t[4] AS DOUBLE) AS w, CAST(t[5] AS DOUBLE) AS h FROM p
  WHERE len(t) >= 5 AND regexp_full_match(t[1], '-?\d+') AND TRY_CAST(t[2] AS DOUBLE) IS NOT NULL AND TRY_CAST(t[3] AS DOUBLE) IS NOT NULL AND TRY_CAST(t[4] AS DOUBLE) IS NOT NULL AND TRY_CAST(t[5] AS DOUBLE) IS NOT NULL)"""
_STRICT, _LENIENT = f"WITH {fx.LINES}, " + _PARSED.format(source="lines"), f"WITH {fx.BAD_LINES}, " + _PARSED.format(source="bad")
_DUCK_V = "v AS (SELECT label AS cls, vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings)"
_DUCK_SIM = f"WITH {_DUCK_V}, s AS (SELECT p.cls, p.id, b.id AS ref, list_inner_product(p.e, b.e) AS sim FROM v p JOIN v b ON p.cls = b.cls AND b.id % 5 = 0 AND b.cls <> 9 WHERE p.id % 5 <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, ref) AS r FROM s)"
_LINES_SQL = """WITH {box}, s AS (SELECT DISTINCT CAST(img AS VARCHAR) AS stem FROM pred), l AS (
  SELECT CAST(img AS VARCHAR) AS stem, string_agg(printf('%d %.6f %.6f %.6f %.6f', cls, (x1 + x2) / 2 / {w}::DOUBLE, (y1 + y2) / 2 / {h}::DOUBLE, (x2 - x1) / {w}::DOUBLE, (y2 - y1) / {h}::DOUBLE), chr(10) ORDER BY cls, ord){end} AS c
  FROM pred WHERE score >= 0.5::DOUBLE AND img % 100 <> 40 GROUP BY img)
SELECT stem, coalesce(c, '') AS content FROM s LEFT JOIN l USING (stem)"""

ORACLES = {
    "parse_labels": _STRICT + " SELECT * FROM parsed",
    "parse_labels_lenient": _LENIENT + " SELECT * FROM parsed",
    "ann_index": _LENIENT + " SELECT stem, line_no, cls, CAST(row_number() OVER (PARTITION BY stem ORDER BY line_no) - 1 AS INT) AS ann_idx FROM parsed WHERE cls IN (0, 2)",
    "discover_classes": rf"WITH {fx.BAD_LINES}, f AS (SELECT {_SPLIT}[1] AS c FROM bad) SELECT DISTINCT CAST(c AS INT) AS cls FROM f WHERE regexp_full_match(c, '-?\d+')",
    "class_names": "SELECT n_nationkey AS cls, n_name AS name FROM nation",
    "class_filter": _STRICT + " SELECT stem, line_no, cls FROM parsed WHERE cls IN (SELECT n_nationkey FROM nation WHERE n_name LIKE '%A%')",
    "stride_sample": "SELECT path FROM (SELECT path, row_number() OVER (ORDER BY path) - 1 AS n FROM (SELECT 'images/' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS path FROM part)) WHERE n % 3 = 0",
    "resolve_source": f"WITH {fx.LINES}{_IMAGES} SELECT s.stem, arg_min(path, ext) AS path FROM stems s LEFT JOIN images i ON i.stem = s.stem GROUP BY s.stem",
    "source_groups": _STRICT + _IMAGES + ", i AS (SELECT stem, min(path) AS path FROM images GROUP BY stem), c AS (SELECT cls, stem, string_agg(n, ',' ORDER BY n) AS crops FROM (SELECT cls, stem, stem || '_cls' || CAST(cls AS VARCHAR) || '_' || CAST(line_no AS VARCHAR) AS n FROM parsed) GROUP BY cls, stem) SELECT c.cls, c.stem, crops, path FROM c JOIN i ON i.stem = c.stem",
    "join_image_label": _STRICT + _IMAGES + " SELECT p.stem, path, line_no, cls FROM parsed p JOIN images i ON i.stem = p.stem AND ext = 'png'",
    "eval_stems": f"WITH {fx.LINES}{_IMAGES}, f AS (SELECT CASE WHEN p_partkey % 5 = 0 THEN CAST(p_partkey AS VARCHAR) || '_preview' WHEN p_partkey = 7 THEN 'summary' ELSE CAST(p_partkey AS VARCHAR) END AS stem FROM part) SELECT DISTINCT 'images' AS source, stem FROM images UNION ALL SELECT 'files', stem FROM f WHERE stem NOT LIKE '%preview' AND stem <> 'summary'",
    "eval_left_join": f"WITH {fx.LINES} SELECT stem, (SELECT count(*) FROM pred p WHERE CAST(p.img AS VARCHAR) = s.stem AND score >= 0.9::DOUBLE AND cls = 1) AS n_pred, (SELECT count(*) FROM gt g WHERE CAST(g.img AS VARCHAR) = s.stem AND cls = 1) AS n_gt FROM (SELECT DISTINCT stem FROM lines) s",
    "local_class_map": _STRICT + " SELECT stem, cls, CAST(dense_rank() OVER (PARTITION BY stem ORDER BY cls) - 1 AS INT) AS local FROM (SELECT DISTINCT stem, cls FROM parsed WHERE cls <> CAST(stem AS BIGINT) % 3)",
    "pair_plan": f"WITH {fx.LINES}{_IMAGES} SELECT stem, n_name AS src FROM images, nation WHERE ext = 'png'",
    "zip_scores": f"WITH {fx.BOX}, b AS (SELECT img, cls, count(*) AS n FROM pred GROUP BY img, cls), s AS (SELECT img, cls, count(*) AS n, sum(score) AS t FROM pred WHERE img % 60 <> 0 OR ord > 3 GROUP BY img, cls) SELECT b.img, b.cls, round(CASE WHEN s.n = b.n THEN t ELSE b.n END, 6) AS score_sum, CAST(b.n AS INT) AS n FROM b LEFT JOIN s ON s.img = b.img AND s.cls = b.cls",
    "yolo_lines": _LINES_SQL.format(box=fx.BOX, w=512, h=640, end=""),
    "yolo_lines_b": _LINES_SQL.format(box=fx.BOX, w=1000, h=1000, end=" || chr(10)"),
    "summary_json_a": f"""WITH {fx.BOX}, t AS (SELECT img, CAST(count(*) FILTER (WHERE score >= 0.5::DOUBLE) AS INT) AS n FROM pred GROUP BY img)
        SELECT CAST(p.img AS VARCHAR) AS stem, CAST(p.img AS VARCHAR) || '.txt' AS label_file, any_value(t.n) AS n_final_total, CAST(cls AS VARCHAR) AS cls, CAST(count(*) AS INT) AS n_proposals, CAST(count(*) FILTER (WHERE score >= 0.1::DOUBLE) AS INT) AS n_wbf,
        CAST(count(*) FILTER (WHERE score >= 0.5::DOUBLE) AS INT) AS n_final, coalesce(sum(x1) FILTER (WHERE score >= 0.5::DOUBLE), 0) AS x1_sum FROM pred p JOIN t ON t.img = p.img GROUP BY p.img, cls""",
    "summary_json_b": f"""WITH {fx.DETS} SELECT CAST(img AS VARCHAR) || '.v2.png' AS file, CAST(img AS VARCHAR) || '.v2.txt' AS label_file, CAST(count(*) OVER (PARTITION BY img) AS INT) AS n_final_total,
        CAST(row_number() OVER (PARTITION BY img ORDER BY cls, ord) - 1 AS INT) AS pos, CAST(cls AS INT) AS class_id, x2, score AS sam3_score, sim AS dino_sim, sim AS combined_score FROM dets""",
    "summary_scores": f"""WITH {fx.DETS} SELECT CAST(img AS VARCHAR) AS stem, CAST(cls AS INT) AS cls, CAST(row_number() OVER (PARTITION BY img, cls ORDER BY ord) - 1 AS INT) AS pos, score FROM pred WHERE score >= 0.5::DOUBLE
        UNION ALL SELECT CAST(img AS VARCHAR) || '.v2', CAST(cls AS INT), CAST(row_number() OVER (PARTITION BY img, cls ORDER BY ord) - 1 AS INT), coalesce(sim, 0) FROM dets""",
    "gallery": "SELECT 'p/img' || CAST(p_partkey AS VARCHAR) || '.png' AS preview, 'img' || CAST(p_partkey AS VARCHAR) || ' | ' || CASE WHEN p_partkey % 4 > 0 THEN CAST(p_size AS VARCHAR) ELSE '?' END || ' box(es)' AS caption FROM part WHERE p_partkey % 3 > 0",
    "export_counts": "SELECT count(*) FILTER (WHERE p_partkey % 7 <> 0) AS copied, count(*) FILTER (WHERE p_partkey % 7 = 0) AS missing FROM part",
    "max_sim": _DUCK_SIM + " SELECT p.cls, p.id, round(r.sim, 6) AS sim, 'ref' || CAST(r.ref AS VARCHAR) AS best_ref FROM v p LEFT JOIN r ON r.id = p.id AND r.r = 1 WHERE p.id % 5 <> 0",
    "sim_gate": _DUCK_SIM + " SELECT cls, id FROM r WHERE r = 1 AND sim >= 0.2::DOUBLE",
    "missing_bank": "SELECT label AS cls, vec_id AS id FROM embeddings WHERE vec_id % 5 <> 0 AND label = 9",
    "source_sim_filter": f"WITH {_DUCK_V}, n AS (SELECT s.id // 100 AS scene FROM v s, v t WHERE s.id % 100 = 7 AND t.id = 0 AND list_inner_product(s.e, t.e) >= 0) SELECT id FROM v WHERE id // 100 IN (SELECT scene FROM n)",
    "cosine": f"WITH {_DUCK_V}, s AS (SELECT cls, unnest(e) AS x, unnest(range(64)) AS i FROM v), m AS (SELECT cls, i, avg(x) AS x FROM s GROUP BY cls, i), c AS (SELECT cls, list(x ORDER BY i) AS c FROM m GROUP BY cls) SELECT id, round(list_inner_product(e, c), 6) AS cosine, round(list_distance(e, c), 6) AS euclid FROM v JOIN c USING (cls)",
    "odd_lines": f"WITH {fx.LINES} SELECT CAST(len({_SPLIT}) AS INT) AS n, count(*) AS lines FROM lines GROUP BY 1",
    "empty_banks": "SELECT label AS cls, CASE WHEN label = 9 THEN 0 ELSE count(*) END AS n FROM embeddings WHERE vec_id % 5 <> 0 GROUP BY label",
    "l2_normalize": f"WITH {_DUCK_V}, s AS (SELECT id, unnest(e) * unnest(range(1, 65)) AS x, CAST(unnest(range(64)) AS INT) AS i FROM v) SELECT id, i, round(x / sqrt(sum(x * x) OVER (PARTITION BY id)), 9) AS v FROM s",
    "centroid": f"WITH {_DUCK_V}, s AS (SELECT cls, unnest(e) AS x, CAST(unnest(range(64)) AS INT) AS i FROM v) SELECT cls, i, round(avg(x), 9) AS v FROM s GROUP BY cls, i",
    "masked_pool": f"WITH {_DUCK_V}, s AS (SELECT id // 10 AS crop, id, unnest(e) AS x, CAST(unnest(range(64)) AS INT) AS i FROM v) SELECT crop, i, round(coalesce(avg(x) FILTER (WHERE id % 10 <> 0 AND id % 7 < 3 AND crop % 4 > 0), max(x) FILTER (WHERE id % 10 = 0)), 9) AS v FROM s GROUP BY crop, i",
    "pooled_all": f"""WITH {_DUCK_V}, s AS (SELECT id // 10 AS crop, id, unnest(e) AS x, CAST(unnest(range(64)) AS INT) AS i FROM v),
        p AS (SELECT 'mask' AS mode, crop, i, CASE WHEN crop % 2 = 0 THEN coalesce(avg(x) FILTER (WHERE id % 10 <> 0 AND id % 7 < 3), max(x) FILTER (WHERE id % 10 = 0)) ELSE avg(x) END AS v FROM s GROUP BY crop, i
          UNION ALL SELECT 'all', crop, i, avg(x) FROM s GROUP BY crop, i)
        SELECT mode, crop, i, round(v / sqrt(sum(v * v) OVER (PARTITION BY mode, crop)), 9) AS v FROM p""",
    "exemplar_prefix": "WITH r AS (SELECT label AS cls, vec_id AS ord, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings WHERE vec_id % 5 = 0 AND label <> 9) SELECT cls, string_agg('ref' || CAST(ord AS VARCHAR), ',' ORDER BY ord) AS refs FROM r WHERE r <= 5 GROUP BY cls",
    "best_mask": f"WITH {fx.BOX}, r AS (SELECT img, cls, ord, score, row_number() OVER (PARTITION BY img, cls ORDER BY score DESC, ord) AS r FROM pred) SELECT img, cls, ord AS best, score FROM r WHERE r = 1",
    "mask_quality": "SELECT p_partkey FROM part WHERE p_size > 0 AND (p_partkey % 100) / 100.0 >= 0.5 AND CAST(p_size * 3 AS DOUBLE) / greatest(p_partkey % 400, 1) >= 0.1::DOUBLE",
    "set_ops": _STRICT + ", a AS (SELECT DISTINCT stem, cls FROM parsed WHERE w < 0.04::DOUBLE), b AS (SELECT DISTINCT stem, cls FROM parsed WHERE h < 0.03::DOUBLE), o AS (SELECT 'union' AS op, * FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersect', * FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'except', * FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) SELECT op, count(*) AS n, CAST(sum(cls) AS BIGINT) AS cls_sum FROM o GROUP BY op",
    "class_rank": f"WITH {fx.BOX}, c AS (SELECT img, cls, count(*) AS n FROM gt GROUP BY img, cls), r AS (SELECT *, row_number() OVER (PARTITION BY img ORDER BY n DESC, cls) AS r FROM c) SELECT img, cls, n, CAST(r AS INT) AS r FROM r WHERE r <= 2",
}
QUERIES = {n: globals()[n] for n in ORACLES}
