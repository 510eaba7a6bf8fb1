"""Label files: lines as Python formats them, and a sink of one file for each image."""

from __future__ import annotations

from urllib.parse import urlsplit
from urllib.request import url2pathname

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from gridloom.functions import boxes
from gridloom.functions.text import crop_name


@pandas_udf(StringType())
def label_line(cls: pd.Series, cx: pd.Series, cy: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
    """``%d %.6f %.6f %.6f %.6f``. The JVM rounds halves of the decimal form, C and Python the exact value; so this is Arrow."""
    return pd.Series(["%d %.6f %.6f %.6f %.6f" % row for row in zip(cls, cx, cy, w, h, strict=True)])


def label_files(dets: DataFrame, stems: DataFrame, width: float, height: float, final_newline: bool = False) -> DataFrame:
    """(stem, content) for each stem, empty without boxes. dets: stem, cls, ord, x1..y2 in pixels; lines by class, then ord."""
    centre = boxes.corners_to_centre(tuple(F.col(c) for c in ("x1", "y1", "x2", "y2")), F.lit(width), F.lit(height))
    lines = dets.select("stem", "cls", "ord", label_line(F.col("cls"), *centre).alias("line"))
    files = lines.groupBy("stem").agg(F.sort_array(F.collect_list(F.struct("cls", "ord", "line"))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    files = files.select("stem", F.concat(text, F.lit("\n")).alias("content") if final_newline else text.alias("content"))
    return stems.select("stem").join(files, "stem", "left").na.fill("", ["content"])


def _opener(spark: SparkSession, folder: str) -> tuple[str, str]:
    """(scheme and authority, path) of a folder; a path without a scheme is on the session's default file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    return whole.getScheme(), whole.toString()


def write_files(files: DataFrame, folder: str, suffix: str = ".txt", name: str = "stem", content: str = "content") -> None:
    """Write each (stem, content), text or bytes, to folder/stem.suffix, by the tasks, on any file system that Arrow knows. A name may hold folders. A
    task that is run again writes the same files again."""
    scheme, uri = _opener(files.sparkSession, folder)

    def write(rows) -> None:
        from pyarrow import fs

        system, path = (fs.LocalFileSystem(), url2pathname(urlsplit(uri).path)) if scheme == "file" else fs.FileSystem.from_uri(uri)
        for stem, body in rows:
            target = f"{path}/{stem}{suffix}"
            system.create_dir(target.rpartition("/")[0], recursive=True)
            with system.open_output_stream(target) as out:
                out.write(body.encode() if isinstance(body, str) else bytes(body))

    files.select(name, content).foreachPartition(write)


def write_crops(crops: DataFrame, folder: str) -> None:
    """Crops (stem, cls, idx, png) as ``cls<id>/<stem>_cls<id>_<idx>.png``."""
    path = F.concat(F.lit("cls"), F.col("cls"), F.lit("/"), crop_name(F.col("stem"), F.col("cls"), F.col("idx")))
    write_files(crops.select(path.alias("stem"), F.col("png").alias("content")), folder, ".png")


def export_labels(entries: DataFrame, files: DataFrame, folder: str) -> tuple[int, int]:
    """Copy the label files of a summary's entries to a folder: (copied, missing). files: (path, content) of those there are."""
    wanted = entries.select(F.col("info.label_file").alias("path")).join(files.select("path", F.col("content")), "path", "left")
    there = wanted.where(F.col("content").isNotNull()).select(F.regexp_extract("path", r"([^/]*)$", 1).alias("stem"), "content")
    write_files(there, folder, "")
    counts = wanted.agg(F.count_if(F.col("content").isNotNull()), F.count_if(F.col("content").isNull())).first()
    return counts[0], counts[1]
