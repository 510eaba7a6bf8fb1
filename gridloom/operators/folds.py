"""Order-dependent reductions of small groups, as folds over sorted arrays.

Every operator takes the columns that make a group (an image and a class, say), collects one sorted array for each group
and folds over it with higher-order functions (hashes have theirs in ``hashes``, in numpy). Rows in a group are ordered by an explicit key, so that results don't depend on
how rows are dealt.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import boxes
from gridloom.functions.vectors import hamming
from gridloom.operators import hashes

BOX = ("x1", "y1", "x2", "y2")
#: A row of a pair: the column of that name.
Side = Callable[[str], Column]


def _grouped(df: DataFrame, group: list[str], *order: Column) -> DataFrame:
    """One row per group with the array ``rows`` of (sort keys, row columns), sorted."""
    keys = [o.alias(f"_k{i}") for i, o in enumerate(order)]
    rest = [c for c in df.columns if c not in group]
    return df.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(*keys, *rest))).alias("rows"))


def greedy_match(preds: DataFrame, truths: DataFrame, group: list[str], thresholds: list[float]) -> DataFrame:
    """preds (group, ord, score, box) x thresholds with ``tp``: 1 for those of ``greedy_hits``, else 0."""
    hits = greedy_hits(preds, truths, group, thresholds).withColumn("tp", F.lit(1))
    every = preds.withColumn("thr", F.explode(F.array(*[F.lit(float(x)) for x in thresholds])))
    return every.join(hits, ["thr", *group, "ord"], "left").na.fill(0, ["tp"])


def greedy_hits(preds: DataFrame, truths: DataFrame, group: list[str], thresholds: list[float]) -> DataFrame:
    """(thr, group, ord) of the predictions that take a truth: in the order of falling score each takes the free truth of the
    greatest IoU (lowest ord among equals) that reaches the threshold.

    A truth below the threshold can't be taken, so only pairs that reach the least one are shuffled; the thresholds part after that.
    """
    if min(thresholds) <= 0:
        raise ValueError("thresholds must be above 0")
    p, t = preds.alias("p"), truths.alias("t")
    same = [F.col(f"p.{g}") == F.col(f"t.{g}") for g in group]
    meets = (F.col("p.x1") < F.col("t.x2")) & (F.col("t.x1") < F.col("p.x2")) & (F.col("p.y1") < F.col("t.y2")) & (F.col("t.y1") < F.col("p.y2"))
    overlap = boxes.iou(tuple(F.col(f"p.{c}") for c in BOX), tuple(F.col(f"t.{c}") for c in BOX))
    pairs = p.join(t, [*same, meets]).select(*[F.col(f"p.{g}") for g in group], F.col("p.ord"), F.col("p.score"), F.col("t.ord").alias("truth"), overlap.alias("iou")).where(F.col("iou") >= min(thresholds))
    # One row for each group: its pairs in the order in which predictions, and of each its truths, have their turn.
    pair = F.struct((-F.col("score")).alias("k"), "ord", (-F.col("iou")).alias("i"), F.col("truth").cast("long").alias("truth"))
    rows = pairs.groupBy(*group).agg(F.sort_array(F.collect_list(pair)).alias("pairs"))
    rows = rows.withColumn("thr", F.explode(F.array(*[F.lit(float(x)) for x in thresholds])))
    nothing = F.array().cast("array<long>")

    def take(s: Column, r: Column) -> Column:
        # A prediction that has taken one is the last hit; its other pairs are passed.
        hit = ~F.array_contains(s["taken"], r["truth"]) & ~F.coalesce(F.try_element_at(s["hits"], F.lit(-1)) == r["ord"], F.lit(False))
        return F.when(hit, F.struct(F.concat(s["taken"], F.array(r["truth"])).alias("taken"), F.concat(s["hits"], F.array(r["ord"])).alias("hits"))).otherwise(s)

    reach = F.filter("pairs", lambda r: -r["i"] >= F.col("thr"))
    start = F.struct(nothing.alias("taken"), nothing.alias("hits"))
    typed = F.transform(reach, lambda r: F.struct(r["ord"].cast("long").alias("ord"), r["truth"].alias("truth")))
    found = F.aggregate(typed, start, take, lambda s: s["hits"])
    return rows.select("thr", *group, F.explode(found).alias("ord"))


def suppress(df: DataFrame, group: list[str], order: list[Column], rejects: Callable[[Side, Side], Column]) -> DataFrame:
    """df with ``kept``: in order, a row is kept unless rejects(row, earlier row) holds for an earlier row that was kept.

    The rows that could reject each other are found by a join; the fold sees only those, as numbers in their group.
    """
    same = [F.col(f"a.{g}") == F.col(f"b.{g}") for g in group]
    near = rejects(lambda c: F.col(f"a.{c}"), lambda c: F.col(f"b.{c}"))
    return _suppressed(df, group, order, lambda ranked: ranked.alias("a").join(ranked.alias("b"), [*same, F.col("b._r") < F.col("a._r"), near]))


def _suppressed(df: DataFrame, group: list[str], order: list[Column], threatened: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """df with ``kept``; threatened(ranked) joins rows (a) with the earlier ones (b) that could reject them."""
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    pairs = threatened(ranked)
    threats = pairs.groupBy(*[F.col(f"a.{g}") for g in group], F.col("a._r")).agg(F.collect_list("b._r").alias("by"))
    queue = threats.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("_r", "by"))).alias("q"))

    def step(s: Column, x: Column) -> Column:
        dead = F.exists(x["by"], lambda k: ~F.array_contains(s, k))
        return F.when(dead, F.concat(s, F.array(x["_r"]))).otherwise(s)

    dropped = queue.select(*group, F.explode(F.aggregate("q", F.array().cast("array<int>"), step)).alias("_r"), F.lit(False).alias("kept"))
    return ranked.join(dropped, [*group, "_r"], "left").na.fill(True, ["kept"]).select(*df.columns, "kept")


def _box(side: Side) -> boxes.Box:
    return tuple(side(c) for c in BOX)


def nms(df: DataFrame, group: list[str], threshold: float) -> DataFrame:
    """Non-maximum suppression: by falling score, out with IoU above the threshold to a kept box."""
    return suppress(df, group, [-F.col("score"), F.col("ord")], lambda a, b: boxes.iou(_box(a), _box(b)) > F.lit(threshold))


def containment_and_duplicates(df: DataFrame, group: list[str], contained: float, duplicate: float) -> DataFrame:
    """By falling raw score, out if contained in a kept box, or nearly equal to it (both inclusive)."""
    rejects = lambda a, b: (boxes.containment(_box(a), _box(b)) >= F.lit(contained)) | (boxes.guarded_iou(_box(a), _box(b)) >= F.lit(duplicate))
    return suppress(df, group, [-F.col("score"), F.col("ord")], rejects)


def near_hashes(left: DataFrame, right: DataFrame, group: list[str], distance: int, hash_col: str = "hash") -> DataFrame:
    """left and right (aliased a and b) joined on the group where the 64-bit hashes differ in at most ``distance`` bits.

    Of distance + 1 pieces of two such hashes one is equal, so this is an equi-join on a piece; a pair counts at its first equal
    piece only. For distances of 32 and more, where pieces are single bits, it is a join on the group.
    """
    ha, hb = F.col(f"a.{hash_col}"), F.col(f"b.{hash_col}")
    near = hamming(ha, hb) <= F.lit(distance)
    same = [F.col(f"a.{g}") == F.col(f"b.{g}") for g in group]
    pieces = distance + 1
    if pieces > 32:
        return left.alias("a").join(right.alias("b"), [*same, near])
    cuts = [64 * i // pieces for i in range(pieces + 1)]
    piece = lambda h, i: F.shiftrightunsigned(h, cuts[i]).bitwiseAND(F.lit((1 << (cuts[i + 1] - cuts[i])) - 1 if pieces > 1 else -1))
    spread = lambda df: df.select("*", F.posexplode(F.array(*[piece(F.col(hash_col), i) for i in range(pieces)])).alias("_piece", "_bits"))
    xor = ha.bitwiseXOR(hb)
    first = F.array_position(F.array(*[piece(xor, i) == 0 for i in range(pieces)]), F.lit(True)) == F.col("a._piece") + 1
    on = [*same, F.col("a._piece") == F.col("b._piece"), F.col("a._bits") == F.col("b._bits"), near, first]
    return spread(left).alias("a").join(spread(right).alias("b"), on)


def hash_dedup(df: DataFrame, group: list[str], distance: int, order: str = "ord", hash_col: str = "hash", block: int = hashes.BLOCK) -> DataFrame:
    """In input order, out if the Hamming distance to a kept hash is at most ``distance``; 0 keeps all, and rows without a hash stay.

    Of equal hashes only the first can be kept, so each hash has its turn once (``hashes.kept_hashes``).
    """
    if distance <= 0:
        return df.withColumn("kept", F.lit(True))
    keys = [*group, "_hash"]
    rows = df.withColumn("_hash", F.col(hash_col))
    known = rows.select(*keys, F.struct(F.col(order)).alias("_first")).dropna(subset=keys)
    firsts = known.groupBy(*keys).agg(F.min("_first").alias("_first"))
    ranked = firsts.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy("_first", "_hash")))
    mark = firsts.join(hashes.kept_hashes(ranked, group, distance, block), keys).withColumn("_kept", F.lit(True)).withColumnRenamed("_first", "_order")
    same = [F.col(f"a.{k}") == F.col(f"m.{k}") for k in keys]
    found = rows.alias("a").join(mark.alias("m"), [*same, F.struct(F.col(f"a.{order}")) == F.col("m._order")], "left")
    # Rows that are alike in place and hash have their turn one after the other.
    once = F.row_number().over(Window.partitionBy(*[F.col(f"a.{k}") for k in keys], F.col(f"a.{order}")).orderBy(F.col("a._hash"))) == 1
    missing = F.lit(False)
    for k in keys:
        missing |= F.col(f"a.{k}").isNull()
    return found.select(*[F.col(f"a.{c}") for c in df.columns], (missing | (F.coalesce(F.col("m._kept"), F.lit(False)) & once)).alias("kept"))


def contained_pairs(df: DataFrame, group: list[str], threshold: float) -> DataFrame:
    """df with ``kept``: pairs i < j in input order; one inside another by more than the threshold drops the lower score,
    the later among equals; a dropped box drops no more."""
    i, j = df.alias("a"), df.alias("b")
    same = [F.col(f"a.{g}") == F.col(f"b.{g}") for g in group]
    one, two = (tuple(F.col(f"{s}.{c}") for c in BOX) for s in "ab")
    pairs = i.join(j, [*same, F.col("a.ord") < F.col("b.ord"), boxes.pixel_containment(one, two) > F.lit(threshold)])
    drop = F.when(F.col("a.score") < F.col("b.score"), F.col("a.ord")).otherwise(F.col("b.ord"))
    pairs = pairs.select(*[F.col(f"a.{g}") for g in group], F.struct(F.col("a.ord").cast("long").alias("i"), F.col("b.ord").cast("long").alias("j"), drop.cast("long").alias("drop")).alias("p"))
    queue = pairs.groupBy(*group).agg(F.sort_array(F.collect_list("p")).alias("q"))

    def step(s: Column, p: Column) -> Column:
        skip = F.array_contains(s, p["i"]) | F.array_contains(s, p["j"])
        return F.when(skip, s).otherwise(F.concat(s, F.array(p["drop"])))

    dropped = queue.select(*group, F.explode(F.aggregate("q", F.array().cast("array<long>"), step)).alias("ord"), F.lit(False).alias("kept"))
    return df.join(dropped, [*group, "ord"], "left").na.fill(True, ["kept"]).select(*df.columns, "kept")


def weighted_fusion(df: DataFrame, group: list[str], threshold: float, models: int = 1, skip: float = 0.0) -> DataFrame:
    """Weighted box fusion: (group, cluster, box, score, n). By falling score a box joins the fused box of the greatest IoU above
    the threshold (the earlier among equals) or opens a cluster; a fused box is the score-weighted mean of its boxes (the plain mean
    where all scores are 0), its score their mean, scaled by min(boxes, models) / models."""
    rows = _grouped(df.where(F.col("score") >= skip), group, -F.col("score"), F.col("ord"))
    kind = "array<struct<x1:double,y1:double,x2:double,y2:double,p1:double,q1:double,p2:double,q2:double,s:double,n:int>>"
    plain = ("p1", "q1", "p2", "q2")  # sums without weights

    def fused(c: Column) -> boxes.Box:
        return tuple(F.when(c["s"] > 0, c[k] / c["s"]).otherwise(c[p] / c["n"]) for k, p in zip(BOX, plain, strict=True))

    def step(s: Column, r: Column) -> Column:
        new = F.struct(*[(r[c] * r["score"]).alias(c) for c in BOX], *[r[c].alias(p) for c, p in zip(BOX, plain, strict=True)], r["score"].alias("s"), F.lit(1).alias("n"))
        overlaps = F.transform(s, lambda c: boxes.iou(fused(c), boxes.corners(r)))
        best = F.array_max(overlaps)
        at = F.array_position(overlaps, best)
        joined = F.transform(s, lambda c, i: F.when(i + 1 == at, F.struct(*[(c[k] + new[k]).alias(k) for k in (*BOX, *plain)], (c["s"] + new["s"]).alias("s"), (c["n"] + 1).alias("n"))).otherwise(c))
        return F.when((F.size(s) > 0) & (best > F.lit(threshold)), joined).otherwise(F.concat(s, F.array(new)))

    typed = F.transform("rows", lambda r: F.struct(*[r[c].cast("double").alias(c) for c in (*BOX, "score")]))
    clusters = F.aggregate(typed, F.array().cast(kind), step)
    out = rows.select(*group, F.posexplode(clusters).alias("cluster", "c"))
    factor = F.least(F.col("c.n"), F.lit(models)) / F.lit(models)
    return out.select(*group, "cluster", *[c.alias(n) for c, n in zip(fused(F.col("c")), BOX, strict=True)], (F.col("c.s") / F.col("c.n") * factor).alias("score"), F.col("c.n").alias("n"))
