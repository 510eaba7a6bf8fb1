"""Label lines ``class cx cy w h [more]``, class lists, and where their images are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions.text import log_lines, stem
from gridloom.operators.ranked import numbered

SUFFIXES = ("jpg", "jpeg", "png", "bmp", "webp")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(stem, line_no, line) of the .txt files in a folder. Files are small, each is read whole."""
    files = spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True).select(stem(file_path()).alias("stem"), "value")
    return files.select("stem", F.posexplode(log_lines(F.col("value"))).alias("line_no", "line"))


def file_path() -> Column:
    """The path of a row's file as it is, not as part of a URL."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


#: White space of any script.
BLANK = r"[\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def parts(line: Column) -> Column:
    """What stands between white space."""
    return F.filter(F.split(line, f"{BLANK}+"), lambda x: x != "")


def _parts(lines: DataFrame) -> DataFrame:
    return lines.withColumn("_p", parts(F.col("line"))).where(F.size("_p") >= 5)


def _cast(part: Column, kind: str, strict: bool) -> Column:
    return part.cast(kind) if strict else part.try_cast(kind)


def parse(lines: DataFrame, strict: bool = True) -> DataFrame:
    """(stem, line_no, cls, cx, cy, w, h). Lines of fewer than five parts are left out; a bad number raises, or if not strict
    its line is left out."""
    rows = _parts(lines)
    # Guarded, as a filter on a column may run before the one on the number of parts.
    part = lambda i: F.when(F.size("_p") >= 5, F.get("_p", F.lit(i)))
    cols = [_cast(part(i), "int" if i == 0 else "double", strict).alias(c) for i, c in enumerate(("cls", "cx", "cy", "w", "h"))]
    rows = rows.select("stem", "line_no", *cols)
    return rows if strict else rows.dropna(subset=["cls", "cx", "cy", "w", "h"])


def indexed(labels: DataFrame, classes: list[int]) -> DataFrame:
    """Labels of the classes with their 0-based number in the file, counted over those kept."""
    order = Window.partitionBy("stem").orderBy("line_no")
    return labels.where(F.col("cls").isin(*classes)).withColumn("ann_idx", F.row_number().over(order) - 1)


def discover_classes(lines: DataFrame) -> DataFrame:
    """The distinct class ids; bad ones are left out."""
    first = F.get(parts(F.col("line")), F.lit(0)).try_cast("int")
    return lines.select(first.alias("cls")).dropna().distinct()


def class_names(text: DataFrame, column: str = "text") -> DataFrame:
    """(cls, name): the non-blank lines, numbered after blank ones are dropped."""
    lines = F.filter(F.transform(log_lines(F.col(column)), lambda x: F.regexp_replace(x, f"^{BLANK}+|{BLANK}+$", "")), lambda x: x != "")
    return text.select(F.posexplode(lines).alias("cls", "name"))


def stride(images: DataFrame, step: int, path: str = "path") -> DataFrame:
    """Every step-th image in the order of paths. Rows are numbered over ranges of paths, not in one task."""
    if step <= 1:
        return images
    return numbered(images, [F.col(path)], "_n").where(F.col("_n") % step == 0).drop("_n")


def source_groups(crops: DataFrame, images: DataFrame) -> DataFrame:
    """(cls, stem, crops, path): crops by class and source, sorted; sources without an image are left out."""
    grouped = crops.groupBy("cls", "stem").agg(F.sort_array(F.collect_list("name")).alias("crops"))
    return grouped.join(images.groupBy("stem").agg(F.min("path").alias("path")), "stem").select("cls", "stem", "crops", "path")
