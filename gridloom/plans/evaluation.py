"""Queries over matching, metrics and order-dependent reductions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom import pipelines
from gridloom.config import Evaluate, Extract, FuseA
from gridloom.functions.vectors import hamming as hamming_distance
from gridloom.functions.vectors import sign_bits
from gridloom.operators import aggregates, cluster, folds, joins, metrics, split
from gridloom.plans import fixtures as fx

GROUP = ["img", "cls"]
KEYS = ("img", "cls", "ord")
EVAL = Evaluate()


def _flags(spark, sf, thresholds=(0.5,)):
    return folds.greedy_match(fx.preds(spark, sf), fx.truths(spark, sf), GROUP, list(thresholds))


def greedy_match(spark, sf):
    return _flags(spark, sf).select(*KEYS, "tp")


def global_flags(spark, sf):
    """The flags in the global order by score, image and place."""
    curve = metrics.pr_curve(_flags(spark, sf), fx.truths(spark, sf), ["cls"], [F.col("img"), F.col("ord")])
    return curve.select("cls", "rank", "tp", "score")


def per_image_stats(spark, sf):
    return metrics.per_image_stats(_flags(spark, sf), fx.truths(spark, sf), GROUP)


def prf1(spark, sf):
    return metrics.precision_recall_f1(per_image_stats(spark, sf))


def pr_curve(spark, sf):
    curve = metrics.pr_curve(_flags(spark, sf), fx.truths(spark, sf), ["cls"], [F.col("img"), F.col("ord")])
    return curve.select("cls", "rank", "cum_tp", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


def ap50(spark, sf):
    truths = fx.truths(spark, sf)
    curve = metrics.pr_curve(_flags(spark, sf), truths, ["cls"], [F.col("img"), F.col("ord")])
    return metrics.average_precision(curve, truths, ["cls"]).select("cls", F.round("ap", 9).alias("ap"))


def _report(spark, sf):
    truths = fx.truths(spark, sf)
    hits = folds.greedy_hits(fx.preds(spark, sf), truths, GROUP, list(EVAL.coco))
    return metrics.evaluate(fx.preds(spark, sf), truths, hits, list(EVAL.coco), EVAL.iou)


def ap_coco(spark, sf):
    return _report(spark, sf).select("cls", F.round("ap50", 9).alias("ap50"), F.round("ap_coco", 9).alias("ap_coco"))


def map_overall(spark, sf):
    total = metrics.overall(_report(spark, sf))
    return total.select(F.round("map50", 9).alias("map50"), F.round("map_coco", 9).alias("map_coco"), "n_pred", "n_gt")


def per_image_pivot(spark, sf):
    return metrics.per_image_matrix(per_image_stats(spark, sf), [0, 1, 2])


def iou_pairs(spark, sf):
    return joins.overlapping(fx.preds(spark, sf), fx.truths(spark, sf), GROUP).select(*GROUP, "ord_a", "ord_b", "iou")


def iou_containment(spark, sf):
    return joins.overlapping(fx.preds(spark, sf), fx.truths(spark, sf), GROUP).select(*GROUP, "ord_a", "ord_b", "iou_guarded", "containment")


def best_containment(spark, sf):
    return joins.best_containment(fx.preds(spark, sf), fx.truths(spark, sf), GROUP)


def _clumped(spark, sf):
    """Predictions drawn together, so that many overlap."""
    rows = fx.preds(spark, sf)
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    x, y = F.floor(F.col("x1") / 5).cast("double"), F.floor(F.col("y1") / 5).cast("double")
    return rows.select(*KEYS, "score", x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + h).alias("y2"))


_CLUMPED = fx.BOX + """,
c AS (SELECT img, cls, ord, score, floor(x1 / 5) AS x1, floor(y1 / 5) AS y1, floor(x1 / 5) + (x2 - x1) AS x2, floor(y1 / 5) + (y2 - y1) AS y2 FROM pred)"""


def nms(spark, sf):
    return folds.nms(_clumped(spark, sf), GROUP, 0.45).select(*KEYS, "kept")


def suppress_b(spark, sf):
    return folds.containment_and_duplicates(_clumped(spark, sf), GROUP, 0.85, 0.85).select(*KEYS, "kept")


def containment_a(spark, sf):
    return folds.contained_pairs(_clumped(spark, sf), GROUP, 0.70).select(*KEYS, "kept")


def wbf(spark, sf):
    out = folds.weighted_fusion(_clumped(spark, sf), GROUP, 0.45)
    return out.where(F.col("score") >= 0.10).select(*GROUP, "cluster", *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2", "score")], "n")


def wbf_all(spark, sf):
    """Fusion without a score gate, zero scores among the boxes."""
    rows = _clumped(spark, sf).withColumn("score", F.when(F.col("ord") % 3 == 0, F.lit(0.0)).otherwise(F.col("score")))
    out = folds.weighted_fusion(rows, GROUP, 0.45)
    return out.select(*GROUP, "cluster", *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2", "score")], "n")


def phash_dedup(spark, sf):
    return folds.hash_dedup(fx.hashes(spark, sf), ["cls"], 20).select("cls", "ord", "kept")


def hamming(spark, sf):
    """Pairs of a class at a distance of 16 at most, far nearer than chance brings them."""
    h = fx.hashes(spark, sf)
    pairs = folds.near_hashes(h, h, ["cls"], 16).where(F.col("a.ord") < F.col("b.ord"))
    return pairs.select(F.col("a.ord").alias("ord_a"), F.col("b.ord").alias("ord_b"), hamming_distance(F.col("a.hash"), F.col("b.hash")).cast("int").alias("distance"))


def fps(spark, sf):
    return cluster.fps(fx.vectors(spark, sf), 10)


def dbscan(spark, sf):
    return cluster.dbscan(fx.vectors(spark, sf), 0.80, 3)


def medoids(spark, sf):
    return cluster.cluster_medoids(fx.vectors(spark, sf), 0.80, 3)


def auto_eps(spark, sf):
    return cluster.auto_eps(fx.vectors(spark, sf), 3, 85.0).select("cls", F.round("eps", 6).alias("eps"))


def cluster_select(spark, sf):
    return cluster.cluster_select(fx.vectors(spark, sf), 12, 0.80, 3)


def cap_shortcut(spark, sf):
    """A cap that no class exceeds keeps every vector in order."""
    return cluster.cluster_select(fx.vectors(spark, sf), 100_000, None, 3)


def extract(spark, sf):
    crops = fx.vectors(spark, sf).withColumn("hash", sign_bits(F.col("emb")))
    return pipelines.extract(crops, Extract(hash_distance=20, min_samples=3, cap=12), eps=0.80)


def _with_vectors(spark, sf, rows):
    """Detections with an embedding each: that of a proposal vector chosen by place."""
    v = fx.vectors(spark, sf).select("id", "emb")
    key = F.pmod(F.col("img") * 31 + F.col("ord") * 7 + F.col("cls"), F.lit(max(1, v.count()))).alias("id")
    return rows.select("*", key).join(joins.small(v), "id").drop("id")


def fuse_b(spark, sf):
    dets = _with_vectors(spark, sf, _clumped(spark, sf))
    return pipelines.fuse_b(dets, fx.bank(spark, sf)).select(*KEYS, "x1", "y1", "x2", "y2", "score", F.round("sim", 6).alias("sim"), F.round("combined", 6).alias("combined"))


def combined_gate(spark, sf):
    dets = _with_vectors(spark, sf, _clumped(spark, sf))
    return pipelines.gate_b(dets, fx.bank(spark, sf)).select(*KEYS, F.round("combined", 6).alias("combined"), "kept")


def fuse_a(spark, sf):
    props = _with_vectors(spark, sf, _clumped(spark, sf)).withColumnRenamed("score", "conf")
    out = pipelines.fuse_a(props, fx.bank(spark, sf), 1000.0, 1000.0, FuseA(sim=0.2, result=0.2, wbf_score=0.1))
    return out.select(*KEYS, *[fx.rounded(F.col(c), 6).alias(c) for c in ("x1", "y1", "x2", "y2", "score")])


def result_gate(spark, sf):
    fused = folds.weighted_fusion(_clumped(spark, sf), GROUP, 0.45)
    both = fused.where(F.col("score") >= 0.10).where(F.col("score") >= 0.50)
    return both.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n"))


def p90_area(spark, sf):
    return aggregates.p90_area(fx.unit(spark, sf))


def median_area(spark, sf):
    return aggregates.median_area(fx.unit(spark, sf))


def small_classes(spark, sf):
    wanted = spark.range(5).select(F.col("id").cast("long").alias("cls"))
    return aggregates.small_classes(aggregates.p90_area(fx.unit(spark, sf).where("cls <> 2 OR h < 0.03")), wanted, 0.004, [1, 9])


def summary_counts(spark, sf):
    rows = fx.preds(spark, sf)
    return rows.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 6).alias("score_sum"))


def stratified_split(spark, sf):
    """150 images with 15 of each class at least."""
    return split.stratified(fx.truths(spark, sf))


def avg_sim(spark, sf):
    return fx.dets(spark, sf).groupBy("img").agg(F.round(aggregates.mean_or_zero(F.when(F.col("score") >= 0.9, F.col("sim"))), 9).alias("avg_sim"))


_FLAGS = """ranked AS (SELECT *, row_number() OVER (PARTITION BY thr, img, cls ORDER BY score DESC, ord) AS r FROM (SELECT pred.*, t.thr FROM pred, thr t)),
pairs AS (
  SELECT p.thr, p.img, p.cls, p.r, g.ord AS truth, (least(p.x2, g.x2) - greatest(p.x1, g.x1)) * (least(p.y2, g.y2) - greatest(p.y1, g.y1)) AS inter,
         (p.x2 - p.x1) * (p.y2 - p.y1) AS a, (g.x2 - g.x1) * (g.y2 - g.y1) AS b
  FROM ranked p JOIN gt g ON p.img = g.img AND p.cls = g.cls AND p.x1 < g.x2 AND g.x1 < p.x2 AND p.y1 < g.y2 AND g.y1 < p.y2),
wants AS (
  SELECT thr, img, cls, r, list(truth ORDER BY inter / (a + b - inter) DESC, truth) FILTER (WHERE inter / (a + b - inter) >= thr) AS w
  FROM pairs GROUP BY thr, img, cls, r),
queue AS (SELECT *, row_number() OVER (PARTITION BY thr, img, cls ORDER BY r) AS q FROM wants WHERE w IS NOT NULL),
fold AS (
  SELECT thr, img, cls, q, r, w[1:1] AS taken, TRUE AS hit FROM queue WHERE q = 1
  UNION ALL
  SELECT n.thr, n.img, n.cls, n.q, n.r, f.taken || list_filter(n.w, lambda x: NOT list_contains(f.taken, x))[1:1], len(list_filter(n.w, lambda x: NOT list_contains(f.taken, x))) > 0
  FROM fold f JOIN queue n ON f.thr = n.thr AND f.img = n.img AND f.cls = n.cls AND n.q = f.q + 1),
flags AS (SELECT p.*, CASE WHEN f.hit THEN 1 ELSE 0 END AS tp FROM ranked p LEFT JOIN fold f ON p.thr = f.thr AND p.img = f.img AND p.cls = f.cls AND p.r = f.r)"""
_COCO = ", ".join(f"({t}::DOUBLE)" for t in EVAL.coco)


def _flagged(rest: str, thresholds: str = "(0.5::DOUBLE)") -> str:
    return f"WITH RECURSIVE {fx.BOX}, thr AS (SELECT * FROM (VALUES {thresholds}) v(thr)), {_FLAGS}{rest}"


_STATS = """, p AS (SELECT img, cls, sum(tp) AS tp, count(*) AS n_pred FROM flags GROUP BY img, cls), g AS (SELECT img, cls, count(*) AS n_gt FROM gt GROUP BY img, cls),
stats AS (SELECT coalesce(p.img, g.img) AS img, coalesce(p.cls, g.cls) AS cls, CAST(coalesce(tp, 0) AS BIGINT) AS tp, CAST(coalesce(n_pred, 0) - coalesce(tp, 0) AS BIGINT) AS fp,
  CAST(coalesce(n_gt, 0) - coalesce(tp, 0) AS BIGINT) AS fn, coalesce(n_pred, 0) AS n_pred, coalesce(n_gt, 0) AS n_gt FROM p FULL JOIN g ON p.img = g.img AND p.cls = g.cls)"""
_CURVE = """, totals AS (SELECT cls, count(*) AS n_gt FROM gt GROUP BY cls),
cum AS (SELECT thr, cls, tp, score, row_number() OVER o AS rank, CAST(sum(tp) OVER o AS BIGINT) AS cum_tp FROM flags WINDOW o AS (PARTITION BY thr, cls ORDER BY score DESC, img, ord ROWS UNBOUNDED PRECEDING)),
curve AS (SELECT c.*, CAST(cum_tp AS DOUBLE) / rank AS precision, CAST(cum_tp AS DOUBLE) / n_gt AS recall, n_gt FROM cum c LEFT JOIN totals USING (cls))"""
# The definition: the best precision of the predictions that reach each of the 101 grid points, which are i * 0.01 (the last is 1).
_AP = _CURVE + """, best AS (SELECT thr, cls, recall, max(precision) AS p FROM curve GROUP BY thr, cls, recall),
env AS (SELECT thr, cls, recall, max(p) OVER (PARTITION BY thr, cls ORDER BY recall DESC) AS p, coalesce(lag(recall) OVER (PARTITION BY thr, cls ORDER BY recall), -1) AS before FROM best),
grid AS (SELECT CASE WHEN i = 100 THEN 1.0::DOUBLE ELSE i * 0.01::DOUBLE END AS t FROM range(101) r(i)),
ap AS (SELECT thr, cls, sum(p) / 101 AS ap FROM env JOIN grid ON t > before AND t <= recall GROUP BY thr, cls),
every AS (SELECT DISTINCT cls, thr FROM gt, thr),
aps AS (SELECT e.cls, e.thr, ap FROM every e LEFT JOIN ap a ON a.cls = e.cls AND a.thr = e.thr)"""


def _kept(condition: str) -> str:
    """SQL of a suppression by falling score; the condition speaks of p (the row) and k (a kept one)."""
    return f"""WITH RECURSIVE {_CLUMPED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY img, cls ORDER BY score DESC, ord) AS r FROM c),
    rows AS (SELECT img, cls, r, {{'ord': ord, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'a': (x2 - x1) * (y2 - y1)}} AS p FROM ranked),
    fold AS (SELECT img, cls, r, p, [p] AS kept, TRUE AS keep FROM rows WHERE r = 1
      UNION ALL SELECT n.img, n.cls, n.r, n.p, CASE WHEN len(list_filter(f.kept, lambda k: {condition})) > 0 THEN f.kept ELSE f.kept || [n.p] END,
        len(list_filter(f.kept, lambda k: {condition})) = 0 FROM fold f JOIN rows n ON n.img = f.img AND n.cls = f.cls AND n.r = f.r + 1)
    SELECT img, cls, p.ord AS ord, keep AS kept FROM fold"""


_INTER = "(greatest(0, least(n.p.x2, k.x2) - greatest(n.p.x1, k.x1)) * greatest(0, least(n.p.y2, k.y2) - greatest(n.p.y1, k.y1)))"
_PAIRS = f"""WITH {fx.BOX}, m AS (SELECT p.img, p.cls, p.ord AS ord_a, g.ord AS ord_b, (least(p.x2, g.x2) - greatest(p.x1, g.x1)) * (least(p.y2, g.y2) - greatest(p.y1, g.y1)) AS inter,
      (p.x2 - p.x1) * (p.y2 - p.y1) AS a, (g.x2 - g.x1) * (g.y2 - g.y1) AS b FROM pred p JOIN gt g ON p.img = g.img AND p.cls = g.cls AND p.x1 < g.x2 AND g.x1 < p.x2 AND p.y1 < g.y2 AND g.y1 < p.y2)"""
_H = "h AS (SELECT label AS cls, vec_id AS ord, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS b FROM embeddings)"
_DIST = "list_sum(list_transform(list_zip({a}, {b}), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END))"

ORACLES = {
    "greedy_match": _flagged(" SELECT img, cls, ord, tp FROM flags"),
    "global_flags": _flagged(_CURVE + " SELECT cls, rank, tp, score FROM curve"),
    "per_image_stats": _flagged(_STATS + " SELECT * FROM stats"),
    "prf1": _flagged(_STATS + """, s AS (SELECT cls, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(n_pred) AS BIGINT) AS n_pred, CAST(sum(n_gt) AS BIGINT) AS n_gt FROM stats GROUP BY cls),
        q AS (SELECT *, CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0 END AS prec, CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0 END AS rec FROM s)
        SELECT *, CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0 END AS f1 FROM q"""),
    "pr_curve": _flagged(_CURVE + " SELECT cls, rank, cum_tp, round(precision, 9) AS precision, round(recall, 9) AS recall FROM curve"),
    "ap50": _flagged(_AP + " SELECT cls, round(ap, 9) AS ap FROM aps"),
    "ap_coco": _flagged(_AP + " SELECT cls, round(max(ap) FILTER (WHERE thr = 0.5::DOUBLE), 9) AS ap50, round(avg(ap), 9) AS ap_coco FROM aps GROUP BY cls", _COCO),
    "map_overall": _flagged(_AP + """, c AS (SELECT cls, max(ap) FILTER (WHERE thr = 0.5::DOUBLE) AS a, avg(ap) AS b FROM aps GROUP BY cls)
        SELECT round(avg(a), 9) AS map50, round(avg(b), 9) AS map_coco, (SELECT count(*) FROM pred) AS n_pred, (SELECT count(*) FROM gt) AS n_gt FROM c""", _COCO),
    "per_image_pivot": _flagged(_STATS + """ SELECT img, """ + ", ".join(f"coalesce(max(CASE WHEN cls = {c} THEN tp::VARCHAR || '/' || fp::VARCHAR || '/' || fn::VARCHAR END), '0/0/0') AS cls{c}" for c in range(3)) + " FROM stats GROUP BY img"),
    "iou_pairs": _PAIRS + " SELECT img, cls, ord_a, ord_b, inter / (a + b - inter) AS iou FROM m",
    "iou_containment": _PAIRS + " SELECT img, cls, ord_a, ord_b, inter / (a + b - inter) AS iou_guarded, inter / least(a, b) AS containment FROM m",
    "best_containment": _PAIRS + """, s AS (SELECT *, inter / least(a, b) AS containment FROM m), b AS (SELECT *, row_number() OVER (PARTITION BY img, cls, ord_a ORDER BY containment DESC, ord_b) AS r FROM s WHERE containment >= 0.25::DOUBLE)
        SELECT p.img, p.cls, p.ord, b.ord_b AS match, b.containment FROM pred p LEFT JOIN (SELECT * FROM b WHERE r = 1) b ON p.img = b.img AND p.cls = b.cls AND p.ord = b.ord_a""",
    "nms": _kept(f"{_INTER} / (n.p.a + k.a - {_INTER}) > 0.45::DOUBLE"),
    "suppress_b": _kept(f"{_INTER} > 0 AND ({_INTER} / least(n.p.a, k.a) >= 0.85::DOUBLE OR {_INTER} / (n.p.a + k.a - {_INTER}) >= 0.85::DOUBLE)"),
    "containment_a": f"""WITH RECURSIVE {_CLUMPED}, hits AS (
        SELECT i.img, i.cls, i.ord AS i, j.ord AS j, CASE WHEN i.score < j.score THEN i.ord ELSE j.ord END AS victim FROM c i JOIN c j ON i.img = j.img AND i.cls = j.cls AND i.ord < j.ord
        WHERE least(i.x2, j.x2) > greatest(i.x1, j.x1) AND least(i.y2, j.y2) > greatest(i.y1, j.y1)
          AND (least(i.x2, j.x2) - greatest(i.x1, j.x1)) * (least(i.y2, j.y2) - greatest(i.y1, j.y1)) / greatest(least((i.x2 - i.x1) * (i.y2 - i.y1), (j.x2 - j.x1) * (j.y2 - j.y1)), 1.0::DOUBLE) > 0.7::DOUBLE),
      q AS (SELECT *, row_number() OVER (PARTITION BY img, cls ORDER BY i, j) AS r FROM hits),
      fold AS (SELECT img, cls, r, [victim] AS gone FROM q WHERE r = 1
        UNION ALL SELECT n.img, n.cls, n.r, CASE WHEN list_contains(f.gone, n.i) OR list_contains(f.gone, n.j) THEN f.gone ELSE f.gone || [n.victim] END FROM fold f JOIN q n ON n.img = f.img AND n.cls = f.cls AND n.r = f.r + 1),
      last AS (SELECT img, cls, arg_max(gone, r) AS gone FROM fold GROUP BY img, cls)
      SELECT c.img, c.cls, c.ord, NOT coalesce(list_contains(l.gone, c.ord), FALSE) AS kept FROM c LEFT JOIN last l ON c.img = l.img AND c.cls = l.cls""",
    "phash_dedup": f"""WITH RECURSIVE {_H}, q AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY ord) AS r FROM h),
      fold AS (SELECT cls, r, ord, [b] AS kept, TRUE AS keep FROM q WHERE r = 1
        UNION ALL SELECT n.cls, n.r, n.ord, CASE WHEN list_min(list_transform(f.kept, lambda k: {_DIST.format(a='k', b='n.b')})) <= 20 THEN f.kept ELSE f.kept || [n.b] END,
          list_min(list_transform(f.kept, lambda k: {_DIST.format(a='k', b='n.b')})) > 20 FROM fold f JOIN q n ON n.cls = f.cls AND n.r = f.r + 1)
      SELECT cls, ord, keep AS kept FROM fold""",
    "hamming": f"WITH {_H} SELECT a.ord AS ord_a, b.ord AS ord_b, CAST({_DIST.format(a='a.b', b='b.b')} AS INT) AS distance FROM h a JOIN h b ON a.cls = b.cls AND a.ord < b.ord WHERE {_DIST.format(a='a.b', b='b.b')} <= 16",
    "p90_area": f"WITH {fx.UNIT}, s AS (SELECT cls, list_sort(list(w * h)) AS a FROM unit GROUP BY cls) SELECT cls, a[CAST(least(trunc(len(a) * 0.9::DOUBLE), len(a) - 1) AS INT) + 1] AS p90_area FROM s",
    "median_area": f"WITH {fx.UNIT} SELECT cls, median(w * h) AS median_area FROM unit GROUP BY cls",
    "small_classes": f"""WITH {fx.UNIT}, s AS (SELECT cls, list_sort(list(w * h)) AS a FROM unit WHERE cls <> 2 OR h < 0.03::DOUBLE GROUP BY cls),
        p AS (SELECT cls, a[CAST(least(trunc(len(a) * 0.9::DOUBLE), len(a) - 1) AS INT) + 1] AS p FROM s)
        SELECT i AS cls FROM range(5) r(i) LEFT JOIN p ON p.cls = i WHERE coalesce(p, 1) < 0.004::DOUBLE OR i IN (1, 9)""",
    "summary_counts": f"WITH {fx.BOX} SELECT img, cls, count(*) AS n, round(sum(score), 6) AS score_sum FROM pred GROUP BY img, cls",
    "avg_sim": f"WITH {fx.DETS} SELECT img, round(coalesce(avg(CASE WHEN score >= 0.9::DOUBLE THEN sim END), 0), 9) AS avg_sim FROM dets GROUP BY img",
}
# Cosine distances inside a class; DuckDB keeps the order of a list, so sums are made alike up to the last bits.
_V = """v AS (SELECT label AS cls, vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
dist AS (SELECT a.cls, a.id AS a, b.id AS b, CASE WHEN a.id = b.id THEN 0 ELSE greatest(0, 1 - list_inner_product(a.e, b.e)) END AS d FROM v a JOIN v b ON a.cls = b.cls)"""
_DBSCAN = _V + """, core AS (SELECT cls, a AS id FROM dist WHERE d <= 0.80::DOUBLE GROUP BY cls, a HAVING count(*) >= 3),
links AS (SELECT d.cls, d.a, d.b FROM dist d JOIN core x ON x.id = d.a JOIN core y ON y.id = d.b WHERE d.d <= 0.80::DOUBLE),
reach AS (SELECT cls, id, id AS root FROM core UNION SELECT l.cls, l.b, r.root FROM reach r JOIN links l ON l.a = r.id),
roots AS (SELECT cls, id, min(root) AS root FROM reach GROUP BY cls, id),
nos AS (SELECT cls, root, CAST(row_number() OVER (PARTITION BY cls ORDER BY root) - 1 AS INT) AS label FROM (SELECT DISTINCT cls, root FROM roots)),
cores AS (SELECT r.cls, r.id, label FROM roots r JOIN nos n ON n.cls = r.cls AND n.root = r.root),
border AS (SELECT d.cls, d.a AS id, min(c.label) AS label FROM dist d JOIN cores c ON c.id = d.b WHERE d.d <= 0.80::DOUBLE AND d.a NOT IN (SELECT id FROM core) GROUP BY d.cls, d.a),
labels AS (SELECT v.cls, v.id, coalesce(c.label, b.label, -1) AS label FROM v LEFT JOIN cores c ON c.id = v.id LEFT JOIN border b ON b.id = v.id)"""
_MEDOIDS = _DBSCAN + """, mean AS (SELECT cls, label, i, avg(x) AS x FROM (SELECT l.cls, label, unnest(e) AS x, unnest(range(len(e))) AS i FROM labels l JOIN v ON v.id = l.id WHERE label >= 0) GROUP BY cls, label, i),
centre AS (SELECT cls, label, list(x ORDER BY i) AS c FROM mean GROUP BY cls, label),
away AS (SELECT l.cls, l.label, l.id, list_distance(v.e, c.c) AS d FROM labels l JOIN v ON v.id = l.id JOIN centre c ON c.cls = l.cls AND c.label = l.label),
med AS (SELECT cls, label, CAST(count(*) AS INT) AS size, arg_min(id, (round(d, 12), id)) AS id FROM away GROUP BY cls, label)"""
_FARTHEST = """vm AS (SELECT cls, i, avg(x) AS x FROM (SELECT cls, unnest(e) AS x, unnest(range(len(e))) AS i FROM src) GROUP BY cls, i),
cm AS (SELECT cls, list(x ORDER BY i) AS c FROM vm GROUP BY cls),
seed AS (SELECT s.cls, arg_max(s.id, (round(list_distance(s.e, c.c), 12), -s.id)) AS id FROM src s JOIN cm c ON c.cls = s.cls GROUP BY s.cls),
walk AS (
  SELECT s.cls, 0 AS pos, s.id, (SELECT list({{'id': x.id, 'd': list_distance(x.e, y.e)}} ORDER BY x.id) FROM src x, src y WHERE x.cls = s.cls AND y.id = s.id) AS away FROM seed s
  UNION ALL
  SELECT w.cls, w.pos + 1, p.id, (SELECT list({{'id': x.id, 'd': least(z.d, list_distance(x.e, y.e))}} ORDER BY x.id) FROM src x, src y, (SELECT unnest(w.away, recursive := true)) z WHERE x.cls = w.cls AND x.id = z.id AND y.id = p.id)
  FROM walk w, (SELECT 1) q, LATERAL (SELECT arg_max(u.id, (round(u.d, 12), -u.id)) AS id FROM (SELECT unnest(w.away, recursive := true)) u) p WHERE w.pos + 1 < {k})"""
_SIM = """, bank AS (SELECT label AS cls, vec_id AS ord, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 5 = 0 AND label <> 9),
e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
keyed AS (SELECT c.*, e.id, e.e FROM c JOIN e ON e.id = (c.img * 31 + c.ord * 7 + c.cls) % (SELECT count(*) FROM embeddings)),
sims AS (SELECT cls, id, max(s) AS sim FROM (SELECT k.cls, k.id, list_inner_product(k.e, b.e) AS s FROM (SELECT DISTINCT cls, id, e FROM keyed) k JOIN bank b ON b.cls = k.cls) GROUP BY cls, id),
gated AS (SELECT k.*, sim, 0.2::DOUBLE * score + 0.8::DOUBLE * sim AS combined FROM keyed k LEFT JOIN sims s ON s.cls = k.cls AND s.id = k.id)"""
_X1, _Y1, _X2, _Y2 = (f"(CASE WHEN k.s > 0 THEN k.{w} / k.s ELSE k.{p} / k.n END)" for w, p in zip("abcd", "efgh", strict=True))
_OPEN = "{{'a': x1 * score, 'b': y1 * score, 'c': x2 * score, 'd': y2 * score, 'e': x1, 'f': y1, 'g': x2, 'h': y2, 's': score, 'n': 1}}"
_JOIN = "{{" + ", ".join(f"'{w}': k.{w} + {c} * score" for w, c in zip("abcd", ("x1", "y1", "x2", "y2"), strict=True)) + ", " + ", ".join(f"'{p}': k.{p} + {c}" for p, c in zip("efgh", ("x1", "y1", "x2", "y2"), strict=True)) + ", 's': k.s + score, 'n': k.n + 1}}"
_MEET = f"(greatest(0, least({_X2}, n.x2) - greatest({_X1}, n.x1)) * greatest(0, least({_Y2}, n.y2) - greatest({_Y1}, n.y1)))"
# A fused box is the weighted mean of its boxes, the plain one (sums e to h) where all scores are 0.
_CLUSTERS = """rows AS (SELECT img, cls, x1, y1, x2, y2, score, row_number() OVER (PARTITION BY img, cls ORDER BY score DESC, ord) AS r FROM {source}),
fold AS (
  SELECT img, cls, r, [""" + _OPEN + """] AS cl FROM rows WHERE r = 1
  UNION ALL
  SELECT img, cls, r, CASE WHEN best > 0.45::DOUBLE THEN list_transform(cl, lambda k, i: CASE WHEN i = list_position(ov, best) THEN """ + _JOIN + """ ELSE k END)
    ELSE cl || [""" + _OPEN + f"""] END
  FROM (SELECT *, list_max(ov) AS best FROM (SELECT n.*, f.cl, list_transform(f.cl, lambda k:
    {_MEET} / (({_X2} - {_X1}) * ({_Y2} - {_Y1}) + (n.x2 - n.x1) * (n.y2 - n.y1) - {_MEET})) AS ov
    FROM fold f JOIN rows n ON n.img = f.img AND n.cls = f.cls AND n.r = f.r + 1))),
last AS (SELECT img, cls, arg_max(cl, r) AS cl FROM fold GROUP BY img, cls),
parts AS (SELECT img, cls, i, cl[i] AS k FROM (SELECT *, unnest(range(1, len(cl) + 1)) AS i FROM last)),
fused AS (SELECT img, cls, i - 1 AS cluster, {_X1} AS x1, {_Y1} AS y1, {_X2} AS x2, {_Y2} AS y2, k.s / k.n AS score, k.n AS n FROM parts)"""
_FUSED = f"WITH RECURSIVE {_CLUMPED}, " + _CLUSTERS.format(source="c")
ORACLES |= {
    "wbf": _FUSED + " SELECT img, cls, CAST(cluster AS INT) AS cluster, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2, round(score, 6) AS score, n FROM fused WHERE score >= 0.10::DOUBLE",
    "wbf_all": f"WITH RECURSIVE {_CLUMPED}, z AS (SELECT * REPLACE (CASE WHEN ord % 3 = 0 THEN 0.0::DOUBLE ELSE score END AS score) FROM c), " + _CLUSTERS.format(source="z") + " SELECT img, cls, CAST(cluster AS INT) AS cluster, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2, round(score, 6) AS score, n FROM fused",
    "result_gate": _FUSED + " SELECT img, cls, count(*) AS n FROM fused WHERE score >= 0.50::DOUBLE GROUP BY img, cls",
    "dbscan": f"WITH RECURSIVE {_DBSCAN} SELECT * FROM labels",
    "medoids": f"WITH RECURSIVE {_MEDOIDS} SELECT * FROM med",
    "auto_eps": f"WITH {_V}, k AS (SELECT cls, a, (list_sort(list(d)))[least(3, len(list(d)))] AS d FROM dist GROUP BY cls, a) SELECT cls, round(quantile_cont(d, 0.85), 6) AS eps FROM k GROUP BY cls",
    "cap_shortcut": "SELECT label AS cls, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INT) AS pos, vec_id AS id FROM embeddings",
    "fps": f"WITH RECURSIVE src AS (SELECT label AS cls, vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), {_FARTHEST.format(k=10)} SELECT cls, pos, id FROM walk",
    "combined_gate": f"WITH {_CLUMPED}{_SIM} SELECT img, cls, ord, round(combined, 6) AS combined, coalesce(combined >= 0.2::DOUBLE, FALSE) AS kept FROM gated",
    "fuse_b": "WITH RECURSIVE" + _kept(f"{_INTER} > 0 AND ({_INTER} / least(n.p.a, k.a) >= 0.85::DOUBLE OR {_INTER} / (n.p.a + k.a - {_INTER}) >= 0.85::DOUBLE)")
    .removeprefix("WITH RECURSIVE").replace(", ranked AS", _SIM + ", passed AS (SELECT * FROM gated WHERE combined >= 0.2::DOUBLE), ranked AS", 1).replace("FROM c)", "FROM passed)", 1)
    .replace("SELECT img, cls, p.ord AS ord, keep AS kept FROM fold", "SELECT f.img, f.cls, f.p.ord AS ord, f.p.x1 AS x1, f.p.y1 AS y1, f.p.x2 AS x2, f.p.y2 AS y2, g.score, round(g.sim, 6) AS sim, round(g.combined, 6) AS combined FROM fold f JOIN passed g ON g.img = f.img AND g.cls = f.cls AND g.ord = f.p.ord WHERE keep"),
}
# Representatives: medoids, large clusters first, then farthest points of the noise; 12 of a class at most.
_SELECT = _MEDOIDS + """, src AS (SELECT v.cls, v.id, v.e FROM v JOIN labels l ON l.id = v.id WHERE l.label = -1), """ + _FARTHEST.format(k=12) + """,
reps AS (SELECT cls, CAST(row_number() OVER (PARTITION BY cls ORDER BY size DESC, label) - 1 AS INT) AS pos, id FROM med),
many AS (SELECT v.cls, (SELECT count(*) FROM reps r WHERE r.cls = v.cls) AS n, (SELECT count(*) FROM src s WHERE s.cls = v.cls) AS m FROM (SELECT DISTINCT cls FROM v) v)
SELECT cls, pos, id FROM reps WHERE pos < 12
UNION ALL SELECT w.cls, CAST(w.pos + n AS INT), w.id FROM walk w JOIN many y ON y.cls = w.cls WHERE w.pos + n < 12 AND w.pos < m"""
_HASHED = ORACLES["phash_dedup"].removeprefix("WITH RECURSIVE ").rpartition("SELECT cls, ord, keep")[0].replace(" fold ", " hfold ")
ORACLES |= {
    "cluster_select": "WITH RECURSIVE " + _SELECT,
    "extract": f"WITH RECURSIVE {_HASHED}, fresh AS (SELECT ord FROM hfold WHERE keep), " + _SELECT.replace("FROM embeddings)", "FROM embeddings WHERE vec_id IN (SELECT ord FROM fresh))", 1),
    "fuse_a": f"WITH RECURSIVE {_CLUMPED}{_SIM}, props AS (SELECT img, cls, ord, x1 / 1000 AS x1, y1 / 1000 AS y1, x2 / 1000 AS x2, y2 / 1000 AS y2, 0.3::DOUBLE * score + 0.7::DOUBLE * sim AS score FROM gated WHERE sim >= 0.2::DOUBLE), "
    + _CLUSTERS.format(source="props")
    + """, px AS (SELECT img, cls, x1 * 1000 AS x1, y1 * 1000 AS y1, x2 * 1000 AS x2, y2 * 1000 AS y2, score, row_number() OVER (PARTITION BY img, cls ORDER BY score DESC, cluster) AS ord FROM fused WHERE score >= 0.2::DOUBLE),
      hits AS (SELECT i.img, i.cls, i.ord AS i, j.ord AS j, CASE WHEN i.score < j.score THEN i.ord ELSE j.ord END AS victim FROM px i JOIN px j ON i.img = j.img AND i.cls = j.cls AND i.ord < j.ord
        WHERE least(i.x2, j.x2) > greatest(i.x1, j.x1) AND least(i.y2, j.y2) > greatest(i.y1, j.y1)
          AND (least(i.x2, j.x2) - greatest(i.x1, j.x1)) * (least(i.y2, j.y2) - greatest(i.y1, j.y1)) / greatest(least((i.x2 - i.x1) * (i.y2 - i.y1), (j.x2 - j.x1) * (j.y2 - j.y1)), 1.0::DOUBLE) > 0.7::DOUBLE),
      q AS (SELECT *, row_number() OVER (PARTITION BY img, cls ORDER BY i, j) AS r FROM hits),
      drops AS (SELECT img, cls, r, [victim] AS gone FROM q WHERE r = 1
        UNION ALL SELECT n.img, n.cls, n.r, CASE WHEN list_contains(f.gone, n.i) OR list_contains(f.gone, n.j) THEN f.gone ELSE f.gone || [n.victim] END FROM drops f JOIN q n ON n.img = f.img AND n.cls = f.cls AND n.r = f.r + 1),
      final AS (SELECT img, cls, arg_max(gone, r) AS gone FROM drops GROUP BY img, cls)
      SELECT p.img, p.cls, CAST(p.ord AS INT) AS ord, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2, round(score, 6) AS score FROM px p LEFT JOIN final l ON p.img = l.img AND p.cls = l.cls
      WHERE NOT coalesce(list_contains(l.gone, p.ord), FALSE)""",
}
NAMES = (
    "greedy_match global_flags per_image_stats prf1 pr_curve ap50 ap_coco map_overall per_image_pivot iou_pairs iou_containment best_containment nms suppress_b containment_a wbf "
    "phash_dedup hamming fps dbscan medoids auto_eps cluster_select cap_shortcut extract fuse_a fuse_b combined_gate result_gate wbf_all p90_area median_area small_classes summary_counts stratified_split avg_sim"
).split()
QUERIES = {n: globals()[n] for n in NAMES}
