"""Clustering of reference vectors by class: farthest-point sampling, density clusters, medoids and their selection.

A class of up to ``LIMIT`` vectors is one group of numpy work (distances take n * n doubles). Larger classes give the same
results by steps that no task does alone: their vectors are packed into blocks, pairs of blocks are compared in tasks of their own
(neighbours within eps, or distances to the nearest few), clusters are connected components of core points by least label, and farthest
points are picked by an arg-max over all tasks, one after the other.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a class that one task takes, and of a block of a larger class.
LIMIT, BLOCK = 12_000, 2_000
#: Rounds after which labels that still change are an error.
MOST_ROUNDS = 1000


def _away(vectors: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.sqrt(((vectors - point) ** 2).sum(1))


def farthest_points(vectors: np.ndarray, k: int) -> list[int]:
    """Indices of k vectors: the farthest from the mean first, then always the farthest from those chosen; lowest index of equals.

    What is kept for each vector is its distance to what was picked; a round is an arg-max and one update of these.
    """
    chosen: list[int] = []
    nearest = _away(vectors, vectors.mean(0)) if len(vectors) else np.empty(0)
    while len(chosen) < min(k, len(vectors)):
        top = int(nearest.argmax())
        update = _away(vectors, vectors[top])
        nearest = np.minimum(nearest, update) if chosen else update
        chosen.append(top)
    return chosen


def _distances(unit: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Cosine distances of unit vectors, not below 0."""
    return np.maximum(1.0 - unit @ others.T, 0.0)


def density_clusters(unit: np.ndarray, eps: float, least: int) -> np.ndarray:
    """Labels by cosine distance: clusters of core points (``least`` points within eps, itself among them), numbered by their lowest
    core point; a border point gets the lowest cluster of its core neighbours, noise -1."""
    near = _distances(unit, unit) <= eps
    np.fill_diagonal(near, True)
    core = near.sum(1) >= least
    root = np.where(core, np.arange(len(unit)), len(unit))
    while True:  # the least core point spreads over links of core points
        spread = np.array([root[row & core].min() if c else len(unit) for row, c in zip(near, core, strict=True)], int)
        spread = np.where(core, spread[np.minimum(spread, len(unit) - 1)], spread)
        if (spread == root).all():
            break
        root = spread
    roots = np.unique(root[core])
    number = np.full(len(unit) + 1, -1)
    number[roots] = np.arange(len(roots))
    labels = number[root]
    for i in np.flatnonzero(~core):
        own = labels[near[i] & core]
        labels[i] = own.min() if len(own) else -1
    return labels


def tuned_eps(unit: np.ndarray, least: int, percentile: float) -> float:
    """The percentile (linear) of the distances to the least-th neighbour, a point being its own first."""
    away = _distances(unit, unit)
    np.fill_diagonal(away, 0.0)
    k = min(least, len(unit)) - 1
    return float(np.percentile(np.partition(away, k, axis=1)[:, k], percentile))


def medoids(unit: np.ndarray, labels: np.ndarray) -> list[tuple[int, int, int]]:
    """(label, size, index of the vector nearest to the cluster's mean), large clusters first, then by label."""
    members = {label: np.flatnonzero(labels == label) for label in sorted(set(labels.tolist()) - {-1})}
    nearest = {label: int(own[_away(unit[own], unit[own].mean(0)).argmin()]) for label, own in members.items()}
    return sorted(((label, len(own), nearest[label]) for label, own in members.items()), key=lambda m: (-m[1], m[0]))


def select(unit: np.ndarray, cap: int, eps: float | None, least: int, percentile: float) -> list[int]:
    """At most cap indices: all if there are no more, else medoids, then farthest points of the noise. eps None: tuned."""
    n = len(unit)
    if n <= cap:
        return [*range(n)]
    labels = density_clusters(unit, eps if eps is not None else tuned_eps(unit, least, percentile), least)
    first = [index for _, _, index in medoids(unit, labels)]
    rest = np.flatnonzero(labels == -1)
    return [*first, *rest[farthest_points(unit[rest], max(0, cap - len(first)))].tolist()][:cap]


# Classes of up to LIMIT vectors.


def _sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("cls").agg(F.count(F.lit(1)).alias("_n"))


def _by_class(df: DataFrame, work: Callable, schema: str) -> DataFrame:
    """work(unit vectors, ids) -> rows, for each class in the order of id."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        rows = work(np.stack(pdf["emb"].to_numpy()).astype(np.float64), pdf["id"].to_numpy())
        return pd.DataFrame([(pdf["cls"].iloc[0], *r) for r in rows], columns=names)

    return df.select("cls", "id", "emb").groupBy("cls").applyInPandas(run, schema)


def _either(df: DataFrame, work: Callable, schema: str, large: Callable[[DataFrame], DataFrame], limit: int) -> DataFrame:
    """Small classes by ``work``, the others by ``large``; which are which is counted first."""
    sizes = _sizes(df)
    if not sizes.where(F.col("_n") > limit).take(1):
        return _by_class(df, work, schema)
    some = lambda over: df.join(sizes.where(F.col("_n") > limit).select("cls"), "cls", "left_semi" if over else "left_anti")
    cast = large(some(True)).selectExpr(*[f"CAST({c.split()[0]} AS {c.split()[1]}) AS {c.split()[0]}" for c in schema.split(", ")])
    return _by_class(some(False), work, schema).unionByName(cast)


# Larger classes, in blocks.


def _cut(df: DataFrame) -> DataFrame:
    """df materialised at this point, in the session's checkpoint folder."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = context.getConf().get("spark.checkpoint.dir", None)
        if folder is None:
            raise RuntimeError("classes above the limit need spark.checkpoint.dir, a folder that the driver and all executors share")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def _packed(df: DataFrame, block: int) -> DataFrame:
    """(cls, b, nb, ids, embs): blocks of about ``block`` vectors of a class."""
    parts = _sizes(df).select("cls", F.ceil(F.col("_n") / block).alias("nb"))
    rows = df.select("cls", "id", "emb").join(parts, "cls").withColumn("b", F.pmod(F.xxhash64("id"), F.col("nb")))
    own = F.sort_array(F.collect_list(F.struct("id", "emb")))
    return rows.groupBy("cls", "b", "nb").agg(own.alias("m")).select("cls", "b", "nb", F.transform("m", lambda x: x["id"]).alias("ids"), F.transform("m", lambda x: x["emb"]).alias("embs"))


def _matrix(column, i: int) -> np.ndarray:
    own = column[i].values
    return np.asarray(own.flatten(), np.float64).reshape(len(own), -1)


def _pairwise(packed: DataFrame, each: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple], schema: str) -> DataFrame:
    """For each block, and each block of its class: each(distances, ids, other ids) -> columns after cls."""
    left = packed.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
    right = packed.select("cls", F.col("b").alias("o"), F.col("ids").alias("oids"), F.col("embs").alias("oembs"))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, other = (np.asarray(batch.column(c)[i].values) for c in ("ids", "oids"))
                away = _distances(_matrix(batch.column("embs"), i), _matrix(batch.column("oembs"), i))
                away[ids[:, None] == other[None, :]] = 0.0
                cols = each(away, ids, other)
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("cls")[i].as_py()] * len(cols[0]), pa.int32()), *(pa.array(c) for c in cols)], names)

    return left.join(right, ["cls", "o"]).select(F.col("cls").cast("int").alias("cls"), "ids", "embs", "oids", "oembs").mapInArrow(run, schema)


def _components(links: DataFrame) -> DataFrame:
    """(cls, id, root) of links (cls, a, b), both ways and of each point to itself: the least id that is connected."""
    state = _cut(links.groupBy("cls", F.col("a").alias("id")).agg(F.min("b").alias("root")))
    for _ in range(MOST_ROUNDS):
        near = links.join(state.select("cls", F.col("id").alias("b"), "root"), ["cls", "b"]).groupBy("cls", F.col("a").alias("id")).agg(F.min("root").alias("root"))
        jump = near.alias("n").join(state.alias("s"), (F.col("n.cls") == F.col("s.cls")) & (F.col("n.root") == F.col("s.id"))).select("n.cls", "n.id", F.least("n.root", "s.root").alias("root"))
        new = _cut(jump)
        if not new.join(state.withColumnRenamed("root", "_old"), ["cls", "id"]).where(F.col("root") != F.col("_old")).take(1):
            return new
        state = new
    raise RuntimeError(f"labels have not settled in {MOST_ROUNDS} rounds")


def _dbscan_large(df: DataFrame, eps: float | DataFrame, least: int, block: int = BLOCK) -> DataFrame:
    """(cls, id, label). eps: one for all, or a table (cls, eps)."""
    most = float(eps) if not isinstance(eps, DataFrame) else float(eps.agg(F.max("eps")).first()[0])

    def each(away, ids, other):
        i, j = np.nonzero(away <= most)
        return ids[i], other[j], away[i, j]

    near = _pairwise(_packed(df, block), each, "cls int, a long, b long, d double")
    if isinstance(eps, DataFrame):
        near = near.join(eps, "cls").where(F.col("d") <= F.col("eps"))
    near = _cut(near.select("cls", "a", "b"))
    core = near.groupBy("cls", "a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("cls", "a")
    links = near.join(core, ["cls", "a"], "left_semi").join(core.withColumnRenamed("a", "b"), ["cls", "b"], "left_semi").select("cls", "a", "b")
    found = _components(_cut(links))
    order = Window.partitionBy("cls").orderBy("root")
    numbers = found.select("cls", "root").distinct().withColumn("label", F.row_number().over(order) - 1)  # a row for each cluster
    cores = _cut(found.join(numbers, ["cls", "root"]).select("cls", "id", "label"))
    border = near.join(core, ["cls", "a"], "left_anti").join(cores.withColumnRenamed("id", "b"), ["cls", "b"]).groupBy("cls", F.col("a").alias("id")).agg(F.min("label").alias("label"))
    return df.select("cls", "id").join(cores.unionByName(border), ["cls", "id"], "left").na.fill(-1, ["label"])


def _eps_large(df: DataFrame, least: int, percentile: float, block: int = BLOCK) -> DataFrame:
    """(cls, eps)."""

    def each(away, ids, other):
        k = min(least, len(other))
        return ids, list(np.sort(np.partition(away, k - 1, axis=1)[:, :k], axis=1))

    few = _pairwise(_packed(df, block), each, "cls int, id long, ds array<double>")
    nearest = few.select("cls", "id", F.explode("ds").alias("d")).groupBy("cls", "id").agg(F.sort_array(F.collect_list("d")).alias("ds"))
    return nearest.groupBy("cls").agg(F.percentile(F.element_at("ds", F.least(F.lit(least), F.size("ds"))), F.lit(percentile / 100)).alias("eps"))


def _mean_by(df: DataFrame, *keys: str) -> DataFrame:
    parts = df.select(*keys, F.posexplode("emb").alias("i", "v")).groupBy(*keys, "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return parts.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("_c"))


def _from(c: str):
    return F.sqrt(F.aggregate(F.zip_with(F.col("emb").cast("array<double>"), F.col(c), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def _medoids_large(df: DataFrame, labels: DataFrame) -> DataFrame:
    """(cls, label, size, id)."""
    rows = df.select("cls", "id", "emb").join(labels.where("label >= 0"), ["cls", "id"])
    away = rows.join(_mean_by(rows, "cls", "label"), ["cls", "label"]).withColumn("_d", _from("_c"))
    best = away.groupBy("cls", "label").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("_d", "id")).alias("m"))
    return best.select("cls", "label", "size", F.col("m.id").alias("id"))


def _fps_large(df: DataFrame, k: DataFrame) -> DataFrame:
    """(cls, pos, id): k farthest points of each class; k: (cls, k)."""
    rows = _cut(df.select("cls", "id", "emb").join(k.where("k > 0"), "cls"))
    state, picked = rows.join(_mean_by(rows, "cls"), "cls").withColumn("_near", _from("_c")).drop("_c"), None
    for pos in range(int(k.agg(F.max("k")).first()[0] or 0)):
        state = _cut(state.where(F.col("k") > pos))
        top = state.groupBy("cls").agg(F.max(F.struct("_near", (-F.col("id")).alias("o"), "emb")).alias("t"))
        top = _cut(top.select("cls", (-F.col("t.o")).alias("id"), F.col("t.emb").cast("array<double>").alias("_c"), F.lit(pos).alias("pos")))
        picked = top.drop("_c") if picked is None else picked.unionByName(top.drop("_c"))
        far = _from("_c")
        state = state.join(top.select("cls", "_c"), "cls").withColumn("_near", F.least("_near", far) if pos else far).drop("_c")
    return df.select("cls", "id").limit(0).withColumn("pos", F.lit(0)) if picked is None else picked.join(rows.groupBy("cls").agg(F.count(F.lit(1)).alias("_n")), "cls").where("pos < _n").select("cls", "pos", "id")


def fps(df: DataFrame, k: int, limit: int = LIMIT) -> DataFrame:
    """(cls, pos, id): k farthest points of each class in the order in which they are picked."""
    large = lambda rows: _fps_large(rows, _sizes(rows).select("cls", F.lit(k).alias("k")))
    return _either(df, lambda v, ids: [(p, int(ids[i])) for p, i in enumerate(farthest_points(v, k))], "cls int, pos int, id long", large, limit)


def dbscan(df: DataFrame, eps: float, least: int, limit: int = LIMIT) -> DataFrame:
    """(cls, id, label)."""
    large = lambda rows: _dbscan_large(rows, eps, least, min(BLOCK, limit))
    return _either(df, lambda v, ids: [(int(i), int(x)) for i, x in zip(ids, density_clusters(v, eps, least), strict=True)], "cls int, id long, label int", large, limit)


def cluster_medoids(df: DataFrame, eps: float, least: int, limit: int = LIMIT) -> DataFrame:
    """(cls, label, size, id)."""
    large = lambda rows: _medoids_large(rows, _dbscan_large(rows, eps, least, min(BLOCK, limit)))
    return _either(df, lambda v, ids: [(a, n, int(ids[i])) for a, n, i in medoids(v, density_clusters(v, eps, least))], "cls int, label int, size int, id long", large, limit)


def auto_eps(df: DataFrame, least: int, percentile: float, limit: int = LIMIT) -> DataFrame:
    """(cls, eps)."""
    large = lambda rows: _eps_large(rows, least, percentile, min(BLOCK, limit))
    return _either(df, lambda v, ids: [(tuned_eps(v, least, percentile),)], "cls int, eps double", large, limit)


def cluster_select(df: DataFrame, cap: int, eps: float | None, least: int, percentile: float = 85.0, limit: int = LIMIT) -> DataFrame:
    """(cls, pos, id): the representatives of each class in order."""

    def large(rows: DataFrame) -> DataFrame:
        few = _sizes(rows).where(F.col("_n") <= cap).select("cls")
        every = rows.join(few, "cls", "left_semi").select("cls", (F.row_number().over(Window.partitionBy("cls").orderBy("id")) - 1).alias("pos"), "id")
        if not _sizes(rows).where(F.col("_n") > cap).take(1):
            return every  # nothing to cluster, and no eps to tune
        rows = rows.join(few, "cls", "left_anti")
        labels = _cut(_dbscan_large(rows, eps if eps is not None else _eps_large(rows, least, percentile, min(BLOCK, limit)), least, min(BLOCK, limit)))
        order = Window.partitionBy("cls").orderBy(F.col("size").desc(), "label")  # a row for each cluster
        first = _cut(_medoids_large(rows, labels).withColumn("pos", F.row_number().over(order) - 1).select("cls", "pos", "id"))
        noise = rows.join(labels.where("label = -1").select("cls", "id"), ["cls", "id"], "left_semi")
        left = labels.select("cls").distinct().join(first.groupBy("cls").agg(F.count(F.lit(1)).alias("m")), "cls", "left").na.fill(0, ["m"])
        rest = _fps_large(noise, left.select("cls", F.greatest(F.lit(cap) - F.col("m"), F.lit(0)).alias("k"))).join(left, "cls")
        return every.unionByName(first.where(F.col("pos") < cap)).unionByName(rest.select("cls", (F.col("pos") + F.col("m")).alias("pos"), "id"))

    return _either(df, lambda v, ids: [(p, int(ids[i])) for p, i in enumerate(select(v, cap, eps, least, percentile))], "cls int, pos int, id long", large, limit)
