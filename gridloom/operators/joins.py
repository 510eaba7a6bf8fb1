"""Joins of images, labels, proposals and reference banks."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridloom.functions import boxes
from gridloom.functions.vectors import dot

#: Rows of a bank that may be broadcast; it is counted first, and a larger one is joined by a shuffle.
BROADCAST_ROWS = 20_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _blocks(bank: DataFrame, group: str, rows: int) -> Iterator[dict]:
    """The bank in blocks of about ``rows`` vectors at most: by group the names and the matrix, in the order of ord, equal vectors once."""
    refs = bank.select(F.col(group).alias("g"), F.col("ord").cast("long").alias("o"), F.col("ref_name").alias("n"), F.col("emb").cast("array<double>").alias("e")).where("g IS NOT NULL AND e IS NOT NULL")
    n = max(1, ceil(refs.count() / rows))
    part = F.pmod(F.xxhash64("g", "o"), F.lit(n))
    for k in range(n):
        found: dict = {}
        for g, o, name, e in refs.where(part == k).orderBy("g", "o", "n").toLocalIterator():
            own = found.setdefault(g, {})
            own.setdefault(tuple(e), (o, name))
        yield {g: ([x[0] for x in own.values()], [x[1] for x in own.values()], np.array(list(own))) for g, own in found.items()}


def max_similarity(props: DataFrame, bank: DataFrame, group: str = "cls", rows_at_once: int = BROADCAST_ROWS) -> DataFrame:
    """props (group, emb, ...) with the greatest cosine to the bank's vectors of its group and that vector's name (the lowest ord
    among equals); null where the group has no bank or the row no vector. Rows stay as they are, without ``emb``.

    The bank goes out in blocks of a bounded size; a task multiplies its rows with a block's matrices, and a row keeps the best of
    the blocks before. Nothing is shuffled or regrouped. Cosines are sums in the order of the vector, whatever the batch: a matrix product
    only picks the vectors that can be the best.
    """
    keep = [c for c in props.columns if c != "emb"]
    rows = props.withColumns({"sim": F.lit(None).cast("double"), "best_ref": F.lit(None).cast("string"), "_o": F.lit(None).cast("long")})
    schema = StructType([*(f for f in rows.schema.fields)])
    for block in _blocks(bank, group, rows_at_once):
        known = props.sparkSession.sparkContext.broadcast(block)  # of a bounded block

        def run(batches, known=known):
            for batch in batches:
                if batch.num_rows:
                    yield _best_of(batch, known.value, group)

        rows = rows.mapInArrow(run, schema)
    return rows.select(*keep, "sim", "best_ref")


def _nearest(vectors: np.ndarray, matrix: np.ndarray, orders: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Of each vector the matrix row of the greatest dot product (the lowest order among equals), and that product, summed in order."""
    rough = vectors @ matrix.T
    error = 4 * matrix.shape[1] * np.finfo(float).eps * np.linalg.norm(vectors, axis=1) * np.linalg.norm(matrix, axis=1).max()
    row, col = np.nonzero(~(rough < (rough.max(1) - 2 * error)[:, None]))  # a NaN leaves all
    exact = np.zeros(len(row))
    for k in range(matrix.shape[1]):
        exact += vectors[row, k] * matrix[col, k]
    ranked = np.lexsort((np.asarray(orders)[col], np.where(np.isnan(exact), -np.inf, -exact), row))
    first = ranked[np.flatnonzero(np.diff(row[ranked], prepend=-1))]
    return col[first], exact[first]


def _best_of(batch: pa.RecordBatch, block: dict, group: str) -> pa.RecordBatch:
    """The batch with what the block betters."""
    names = batch.schema.names
    sim, ref, at = (batch.column(c).to_pylist() for c in ("sim", "best_ref", "_o"))
    by: dict = {}
    vectors = batch.column("emb")
    for i, (g, there) in enumerate(zip(batch.column(group).to_pylist(), vectors.is_valid().to_pylist(), strict=True)):
        if there and g in block:
            by.setdefault(g, []).append(i)
    for g, own in by.items():
        orders, refs, matrix = block[g]
        part = vectors.take(pa.array(own))
        at_best, found = _nearest(np.asarray(part.flatten(), np.float64).reshape(len(own), -1), matrix, orders)
        for i, k, best in zip(own, at_best.tolist(), found.tolist(), strict=True):
            if sim[i] is None or (best, -orders[k]) > (sim[i], -at[i]):
                sim[i], ref[i], at[i] = best, refs[k], orders[k]
    new = {"sim": pa.array(sim, pa.float64()), "best_ref": pa.array(ref, pa.string()), "_o": pa.array(at, pa.int64())}
    return pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in names], names)


def overlapping(left: DataFrame, right: DataFrame, group: list[str]) -> DataFrame:
    """Pairs of boxes of a group that meet: ord_a, ord_b, iou."""
    a, b = left.alias("a"), right.alias("b")
    meets = (F.col("a.x1") < F.col("b.x2")) & (F.col("b.x1") < F.col("a.x2")) & (F.col("a.y1") < F.col("b.y2")) & (F.col("b.y1") < F.col("a.y2"))
    box = lambda s: tuple(F.col(f"{s}.{c}") for c in ("x1", "y1", "x2", "y2"))
    return a.join(b, [*[F.col(f"a.{g}") == F.col(f"b.{g}") for g in group], meets]).select(
        *[F.col(f"a.{g}").alias(g) for g in group], F.col("a.ord").alias("ord_a"), F.col("b.ord").alias("ord_b"),
        boxes.iou(box("a"), box("b")).alias("iou"), boxes.guarded_iou(box("a"), box("b")).alias("iou_guarded"), boxes.containment(box("a"), box("b")).alias("containment"),
    )


def best_containment(prompts: DataFrame, outputs: DataFrame, group: list[str], least: float = 0.25) -> DataFrame:
    """For each prompt the output that contains it best (the first among equals), null below ``least``."""
    pairs = overlapping(prompts, outputs, group).where(F.col("containment") >= least)
    best = pairs.groupBy(*group, "ord_a").agg(F.max(F.struct("containment", (-F.col("ord_b")).alias("o"))).alias("b"))
    found = best.select(*group, F.col("ord_a").alias("ord"), (-F.col("b.o")).alias("match"), F.col("b.containment").alias("containment"))
    return prompts.select(*group, "ord").join(found, [*group, "ord"], "left")


def resolve(stems: DataFrame, images: DataFrame) -> DataFrame:
    """stems with the path of the image of that stem, the first extension in order; null if there is none."""
    first = images.groupBy("stem").agg(F.min(F.struct("ext", "path")).alias("f")).select("stem", F.col("f.path").alias("path"))
    return stems.join(first, "stem", "left")


def eval_stems(images: DataFrame | None, files: DataFrame) -> DataFrame:
    """The distinct stems to evaluate: those of the images; without an image folder (None) those of the label files, but for previews
    and summaries."""
    if images is not None:
        return images.select("stem").distinct()
    return files.select("stem").where(~F.col("stem").endswith("_preview") & (F.col("stem") != "summary")).distinct()


def near_scenes(vectors: DataFrame, scenes: DataFrame, target: DataFrame, least: float, key: str = "scene") -> DataFrame:
    """The vectors of the scenes (key, emb; one for each) that are similar enough to the target scene (emb; one row)."""
    one = target.select(F.col("emb").alias("_t")).limit(1)
    near = scenes.crossJoin(F.broadcast(one)).where(dot(F.col("emb"), F.col("_t")) >= F.lit(float(least))).select(key)
    return vectors.join(near, key, "left_semi")


def good_masks(masks: DataFrame, score: float, share: float) -> DataFrame:
    """The rows (mask_area, bbox_area, sam_score) whose mask is not empty, sure enough, and fills enough of its box."""
    filled = F.col("mask_area") / F.greatest(F.col("bbox_area"), F.lit(1))
    return masks.where((F.col("mask_area") > 0) & (F.col("sam_score") >= F.lit(score)) & (filled >= F.lit(share)))


def with_bank(props: DataFrame, crops: DataFrame, cls: str = "cls") -> tuple[DataFrame, DataFrame]:
    """props of classes that have crops, and the wanted classes whose crop folder is empty, which are skipped."""
    there = crops.select(cls).distinct()
    return props.join(there, cls, "left_semi"), props.select(cls).distinct().join(there, cls, "left_anti")


def local_classes(labels: DataFrame) -> DataFrame:
    """(stem, cls, local): the dense index of a class among the sorted classes of its stem."""
    return labels.select("stem", "cls").distinct().withColumn("local", F.dense_rank().over(Window.partitionBy("stem").orderBy("cls")) - 1)


def zip_scores(boxed: DataFrame, scores: DataFrame, keys: list[str]) -> DataFrame:
    """Arrays of boxes and scores by keys put together; all scores are 1 where the lengths differ or there are none."""
    both = boxed.join(scores, keys, "left")
    same = F.size("boxes") == F.size(F.coalesce("scores", F.array().cast("array<double>")))
    return both.withColumn("scores", F.when(same, F.col("scores")).otherwise(F.transform("boxes", lambda _: F.lit(1.0))))


def pair_plan(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Each source with each target: the work list of the proposal stage, which needs all of it. The sources are the small side."""
    return targets.crossJoin(small(sources))
