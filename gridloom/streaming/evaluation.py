"""Running counts over label files that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.text import log_lines, stem
from gridloom.sources.labels import file_path, parse


def label_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(stem, line_no, cls, cx, cy, w, h) of label files as they appear in a folder; bad lines are left out."""
    files = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.txt").load(folder)
    lines = files.select(stem(file_path()).alias("stem"), F.posexplode(log_lines(F.col("value"))).alias("line_no", "line"))
    return parse(lines, strict=False)


def class_counts(labels: DataFrame) -> DataFrame:
    """Boxes and mean area by class, for output mode complete or update."""
    return labels.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("w") * F.col("h")).alias("area"))
