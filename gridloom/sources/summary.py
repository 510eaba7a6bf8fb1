"""JSON summaries in their two shapes: boxes nested by class (A) and flat (B)."""

from __future__ import annotations

from json import dumps, loads

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.text import stem
from gridloom.sources.writers import write_files

_A = "struct<n_proposals:int,n_wbf:int,n_final:int,boxes:array<struct<xyxy:array<double>,score:double>>>"
_B = "struct<class_id:int,box:array<double>,sam3_score:double,dino_sim:double,combined_score:double>"
SCHEMA = f"map<string,struct<label_file:string,preview_file:string,n_final_total:int,classes:map<string,{_A}>,boxes:array<{_B}>>>"


def parse(texts: DataFrame, column: str = "json") -> DataFrame:
    """(file, stem, info): an entry of each image of each document."""
    entries = texts.select(F.explode(F.from_json(column, SCHEMA)).alias("file", "info"))
    return entries.select("file", stem(F.col("file")).alias("stem"), "info")


def scores(entries: DataFrame) -> DataFrame:
    """(stem, cls, pos, score): shape A by the presence of ``classes``; in shape B the combined score, null as 0."""
    nested = entries.where(F.col("info.classes").isNotNull()).select("stem", F.explode("info.classes").alias("cls", "c"))
    nested = nested.select("stem", F.col("cls").cast("int").alias("cls"), F.posexplode("c.boxes").alias("pos", "b")).select("stem", "cls", "pos", F.col("b.score").alias("score"))
    flat = entries.where(F.col("info.classes").isNull()).select("stem", F.posexplode("info.boxes").alias("at", "b"))
    by_class = flat.groupBy("stem", F.col("b.class_id").alias("cls")).agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("b.combined_score", F.lit(0.0)).alias("score")))).alias("s"))
    flat = by_class.select("stem", "cls", F.posexplode("s").alias("pos", "s")).select("stem", "cls", "pos", F.col("s.score").alias("score"))
    return nested.unionByName(flat)


def gallery(entries: DataFrame) -> DataFrame:
    """(preview, caption) of entries that have a preview."""
    caption = F.concat_ws("", "stem", F.lit(" | "), F.coalesce(F.col("info.n_final_total").cast("string"), F.lit("?")), F.lit(" box(es)"))
    return entries.where(F.coalesce("info.preview_file", F.lit("")) != "").select(F.col("info.preview_file").alias("preview"), caption.alias("caption"))


def export_counts(entries: DataFrame, files: DataFrame) -> DataFrame:
    """How many label files of the summary are among ``files`` (path): copied and missing."""
    wanted = entries.select(F.col("info.label_file").alias("path"))
    found = wanted.join(files.select("path", F.lit(True).alias("there")).distinct(), "path", "left")
    return found.agg(F.count_if(F.col("there").isNotNull()).alias("copied"), F.count_if(F.col("there").isNull()).alias("missing"))


def build_a(boxes: DataFrame, counts: DataFrame) -> DataFrame:
    """(file, json) of shape A. boxes: file, cls, ord, x1..y2, score; counts: file, cls, n_proposals, n_wbf for each class."""
    own = boxes.groupBy("file", "cls").agg(F.sort_array(F.collect_list(F.struct("ord", F.array("x1", "y1", "x2", "y2").alias("xyxy"), "score"))).alias("b"))
    rows = counts.join(own, ["file", "cls"], "left").withColumn("b", F.coalesce("b", F.array().cast(own.schema["b"].dataType)))
    entry = F.struct("n_proposals", "n_wbf", F.size("b").alias("n_final"), F.transform("b", lambda x: F.struct(x["xyxy"].alias("xyxy"), x["score"].alias("score"))).alias("boxes"))
    files = rows.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("cls", entry.alias("e")))).alias("c"), F.sum(F.size("b")).cast("int").alias("n"))
    classes = F.map_from_entries(F.transform("c", lambda x: F.struct(x["cls"].cast("string"), x["e"])))
    info = F.struct(_label(F.col("file")).alias("label_file"), F.lit(None).cast("string").alias("preview_file"), classes.alias("classes"), F.col("n").alias("n_final_total"))
    return files.select("file", F.to_json(F.map_from_entries(F.array(F.struct(F.col("file"), info))), {"ignoreNullFields": "false"}).alias("json"))


def build_b(dets: DataFrame) -> DataFrame:
    """(file, json) of shape B. dets: file, cls, ord, x1..y2, score, sim, combined."""
    box = F.struct(F.col("cls").alias("class_id"), F.array("x1", "y1", "x2", "y2").alias("box"), F.col("score").alias("sam3_score"), F.col("sim").alias("dino_sim"), F.col("combined").alias("combined_score"))
    files = dets.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("cls", "ord", box.alias("b")))).alias("d"))
    info = F.struct(_label(F.col("file")).alias("label_file"), F.lit(None).cast("string").alias("preview_file"), F.size("d").alias("n_final_total"), F.transform("d", lambda x: x["b"]).alias("boxes"))
    return files.select("file", F.to_json(F.map_from_entries(F.array(F.struct(F.col("file"), info))), {"ignoreNullFields": "false"}).alias("json"))


def document(entries: DataFrame) -> DataFrame:
    """(json) one row: the entries (file, json), one for each image, as a single document with two blanks of indent, in the order of files.

    The document is the format's own unit and must fit in a row; for many images keep the entries, which ``parse`` reads as well.
    """
    own = F.sort_array(F.collect_list(F.struct("file", "json")))

    def laid_out(json: pd.Series) -> pd.Series:
        return pd.Series([dumps(loads(x), indent=2, ensure_ascii=True) for x in json])

    joined = entries.agg(F.concat(F.lit("{"), F.array_join(F.transform(own, lambda e: F.substr(e["json"], F.lit(2), F.length(e["json"]) - 2)), ","), F.lit("}")).alias("json"))
    return joined.select(F.pandas_udf(laid_out, "string")("json").alias("json"))


def write_document(entries: DataFrame, folder: str) -> None:
    """The document as ``summary.json`` in a folder."""
    write_files(document(entries).select(F.lit("summary").alias("stem"), F.col("json").alias("content")), folder, ".json")


def _label(file: Column) -> Column:
    return F.concat(stem(file), F.lit(".txt"))
