"""Row numbers over a whole table without a window in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of the order: the table of their sizes is what a single task numbers.
RANGES = 64


def numbered(df: DataFrame, order: list[Column], name: str, ranges: int = RANGES) -> DataFrame:
    """df with the 0-based number of each row in ``order``, which must tell rows apart.

    The order is cut at approximate quantiles of its first column (of a string, its first bytes); rows are numbered in each range, and the
    ranges' sizes are summed up. A range is a function of the row, so a lost task gives the same numbers again.
    """
    first = order[0]
    kind = df.select(first.alias("k")).schema["k"].dataType.simpleString()
    if kind in ("string", "binary"):
        key = F.conv(F.substring(F.hex(F.rpad(first.cast("string"), 7, " ")), 1, 14), 16, 10).cast("double")
    else:
        key = first.cast("double")
    cuts = df.select(F.percentile_approx(key, F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), 10_000)).first()[0] or []
    cuts = sorted(set(cuts))
    part = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c < key)) if cuts else F.lit(0)
    rows = df.withColumn("_range", part)
    counts = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = F.broadcast(counts.select("_range", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before")))  # a row for each range
    local = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return rows.withColumn("_local", local).join(offsets, "_range").withColumn(name, F.col("_local") + F.col("_before")).drop("_range", "_local", "_before")
