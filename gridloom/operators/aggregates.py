"""Aggregations with the exact definitions that thresholds rely on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.vectors import normalised


#: Ranges that a group's values are cut into to find a rank.
RANGES = 256


def at_ranks(values: DataFrame, group: str, ranks: dict[str, Callable[[Column], Column]], ranges: int = RANGES) -> DataFrame:
    """(group, name...): from (group, v) the values at 0-based ranks, which are functions of the group's size.

    Values are counted in ranges between approximate quantiles of their group; only the ranges that hold a rank are looked at more
    closely, by counts of equal values. So no task gets more of a group than its small share, and equal values are one row.
    """
    values = values.where(F.col("v").isNotNull())
    cuts = values.groupBy(group).agg(F.percentile_approx("v", F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), 10_000).alias("cuts"))
    counts = values.groupBy(group, "v").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.join(cuts, group).select(group, "v", "n", F.size(F.filter("cuts", lambda c: c < F.col("v"))).alias("r"))
    before = Window.partitionBy(group).orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(group, "r").agg(F.sum("n").alias("c"))
    sums = sums.select(group, "r", "c", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("first"), F.sum("c").over(Window.partitionBy(group)).alias("total"))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), at(F.col("total")).cast("long").alias("at")) for name, at in ranks.items()]))
    held = sums.select(group, "r", "first", "c", wanted.alias("w")).where((F.col("w.at") >= F.col("first")) & (F.col("w.at") < F.col("first") + F.col("c")))
    upto = Window.partitionBy(group, "w").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.select(group, "r", "v", "n").join(held.select(group, "r", "first", "w"), [group, "r"]).withColumn("end", F.col("first") + F.sum("n").over(upto))
    found = inside.where((F.col("end") > F.col("w.at")) & (F.col("end") - F.col("n") <= F.col("w.at")))
    return found.groupBy(group).agg(*[F.max(F.when(F.col("w.name") == name, F.col("v"))).alias(name) for name in ranks])


def p90_area(labels: DataFrame, cls: str = "cls") -> DataFrame:
    """Nearest-rank 90th percentile of the boxes' areas by class: element int(0.9 n) of the sorted ones, the last at most."""
    areas = labels.select(cls, (F.col("w") * F.col("h")).alias("v"))
    return at_ranks(areas, cls, {"p90_area": lambda n: F.least((n * F.lit(0.9)).cast("long"), n - 1)})


def median_area(labels: DataFrame, cls: str = "cls") -> DataFrame:
    """Median of the boxes' areas by class, the mean of the two in the middle."""
    areas = labels.select(cls, (F.col("w") * F.col("h")).alias("v"))
    both = at_ranks(areas, cls, {"low": lambda n: F.floor((n - 1) / 2), "high": lambda n: F.floor(n / 2)})
    return both.select(cls, ((F.col("low") + F.col("high")) / 2).alias("median_area"))


def small_classes(p90: DataFrame, wanted: DataFrame, limit: float, forced: list[int]) -> DataFrame:
    """Wanted classes whose p90 area is below the limit (1 without boxes), and the forced ones among them."""
    areas = wanted.join(p90, "cls", "left").na.fill(1.0, ["p90_area"])
    return areas.where((F.col("p90_area") < limit) | F.col("cls").isin(*forced)).select("cls")


def centroid(vectors: DataFrame, cls: str = "cls") -> DataFrame:
    """Mean vector by class, by element."""
    parts = vectors.select(cls, F.posexplode("emb").alias("i", "v")).groupBy(cls, "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return parts.groupBy(cls).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("centroid"))


def masked_pool(tokens: DataFrame, key: str = "crop", every: bool = False, unit: bool = False) -> DataFrame:
    """(key, i, v) mean of the tokens under the mask by element, else the class token's value. tokens: key, token, is_cls, masked, emb.

    A crop without a mask (``masked`` null in all its rows), or any crop with ``every``, gets the mean of all its tokens. ``unit``
    brings the vector to length 1; a zero vector stays.
    """
    parts = tokens.select(key, "is_cls", "masked", F.posexplode("emb").alias("i", "v"))
    v = F.col("v").cast("double")
    masked = F.coalesce(F.avg(F.when(F.col("masked") & ~F.col("is_cls"), v)), F.max(F.when(F.col("is_cls"), v)))
    pooled = F.avg(v) if every else F.when(F.count("masked") == 0, F.avg(v)).otherwise(masked)
    out = parts.groupBy(key, "i").agg(pooled.alias("v"))
    if not unit:
        return out
    whole = out.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("e"))
    return whole.select(key, F.posexplode(normalised(F.col("e"))).alias("i", "v"))


def mean_or_zero(value: Column) -> Column:
    return F.coalesce(F.avg(value), F.lit(0.0))
