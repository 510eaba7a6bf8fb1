"""A stratified set of images for evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PER_CLASS, TOTAL = 15, 150


def stratified(labels: DataFrame, per_class: int = PER_CLASS, total: int = TOTAL, seed: int = 0) -> DataFrame:
    """(img, cls) -> (img, pos): images such that each class has ``per_class`` of them where there are so many, filled up to ``total``.

    Rarest classes first, as their images count for the others too; images are drawn in the order of a keyed hash, so the same table
    gives the same set. One small query for each class (they are few); the driver holds the chosen images only, at most
    ``total`` and ``per_class`` for each class.
    """
    own = labels.select("img", "cls").distinct()
    images = own.groupBy("img").agg(F.collect_set("cls").alias("classes")).withColumn("h", F.xxhash64(F.lit(seed), "img"))
    chosen: dict = {}

    def draw(rows: DataFrame, n: int) -> None:
        if n > 0:
            fresh = rows.where(~F.col("img").isin(list(chosen))) if chosen else rows
            for r in fresh.orderBy("h", "img").limit(n).collect():
                chosen[r.img] = set(r.classes)

    for r in own.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).orderBy("n", "cls").collect():
        draw(images.where(F.array_contains("classes", r.cls)), per_class - sum(r.cls in c for c in chosen.values()))
    draw(images, total - len(chosen))
    kind = labels.schema["img"].dataType.simpleString()
    return labels.sparkSession.createDataFrame([(img, pos) for pos, img in enumerate(chosen)], f"img {kind}, pos int")
