"""Views on the driver's tables that exercise the operators; the same SQL text runs on Spark and DuckDB.

A canvas of 1000 x 1000 pixels holds 20 consecutive orders as one image, with three classes. All coordinates are whole numbers, so
both engines agree exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.vectors import sign_bits

BOX = """box AS (
  SELECT l_orderkey - l_orderkey % 20 AS img, l_linenumber % 3 AS cls,
         CAST((l_partkey * 13 + l_suppkey * 7) % 560 AS DOUBLE) AS x1, CAST((l_suppkey * 31 + l_orderkey * 11) % 560 AS DOUBLE) AS y1,
         20 + l_quantity AS w, CAST(20 + l_partkey % 60 AS DOUBLE) AS h,
         CAST(l_partkey % 9 AS DOUBLE) AS jx, CAST(l_suppkey % 7 AS DOUBLE) AS jy,
         CAST((l_partkey * 7919 + l_orderkey * 104729 + l_linenumber * 31) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS score,
         l_returnflag AS rf,
         row_number() OVER (PARTITION BY l_orderkey - l_orderkey % 20, l_linenumber % 3
           ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS ord
  FROM lineitem),
gt AS (SELECT img, cls, ord, x1, y1, x1 + w AS x2, y1 + h AS y2 FROM box WHERE rf <> 'A'),
pred AS (SELECT img, cls, ord, score, x1 + jx AS x1, y1 + jy AS y1, x1 + jx + w AS x2, y1 + jy + h AS y2 FROM box WHERE rf <> 'R')"""

#: Normalised centre boxes of the truths.
UNIT = BOX + """,
unit AS (SELECT img, cls, ord, (x1 + x2) / 2 / 1000 AS cx, (y1 + y2) / 2 / 1000 AS cy, (x2 - x1) / 1000 AS w, (y2 - y1) / 1000 AS h FROM gt)"""

#: Label lines of the truths; some have a part too few, some a part too many, some tabs and form feeds at their ends or between.
LINES = UNIT + """,
numbered AS (SELECT *, row_number() OVER (PARTITION BY img ORDER BY cls, ord) - 1 AS line_no FROM unit),
lines AS (
  SELECT CAST(img AS VARCHAR(20)) AS stem, line_no,
         CASE WHEN (img + line_no) % 50 = 7 THEN printf('%d %.6f %.6f %.6f', cls, cx, cy, w)
              WHEN (img + line_no) % 50 = 8 THEN concat(printf('%d %.6f %.6f %.6f', cls, cx, cy, w), chr(9))
              WHEN (img + line_no) % 50 = 10 THEN concat(chr(9), printf('%d %.6f %.6f %.6f %.6f', cls, cx, cy, w, h), chr(9), chr(11))
              WHEN (img + line_no) % 50 = 11 THEN concat(chr(12), printf('%d', cls), chr(9), chr(9), printf('%.6f %.6f %.6f %.6f', cx, cy, w, h))
              WHEN (img + line_no) % 50 = 9 THEN printf('%d %.6f %.6f %.6f %.6f 0.9', cls, cx, cy, w, h)
              ELSE printf(' %d %.6f  %.6f %.6f %.6f', cls, cx, cy, w, h) END AS line
  FROM numbered)"""
#: The same with bad class ids and bad numbers.
BAD_LINES = LINES + """,
bad AS (
  SELECT stem, line_no, CASE WHEN CAST(stem AS BIGINT) % 60 = 20 AND line_no % 5 = 1 THEN 'x 0.5 0.5 0.1 0.1'
                             WHEN CAST(stem AS BIGINT) % 60 = 40 AND line_no % 5 = 2 THEN '0 a 0.5 0.1 0.1' ELSE line END AS line
  FROM lines)"""
#: Detections of images, with a similarity that is sometimes missing.
DETS = BOX + """,
dets AS (SELECT *, CASE WHEN ord % 11 = 0 THEN NULL ELSE CAST((img * 37 + ord * 101 + cls * 13) % 997 AS DOUBLE) / CAST(997 AS DOUBLE) END AS sim FROM pred)"""


def select(spark: SparkSession, sf_dir: str, views: str, query: str, *tables: str) -> DataFrame:
    """The query over the views, on Spark."""
    for t in tables or ("lineitem",):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(f"WITH {views} {query}" if views else query)


def rounded(c: Column, digits: int) -> Column:
    """c rounded as DuckDB does, after scaling. F.round looks at the decimal digits, which differs where the scaled value comes to a half."""
    scale = F.lit(10.0**digits)
    return F.round(c * scale) / scale


def truths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(spark, sf_dir, BOX, "SELECT * FROM gt")


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(spark, sf_dir, BOX, "SELECT * FROM pred")


def unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(spark, sf_dir, UNIT, "SELECT * FROM unit")


def lines(spark: SparkSession, sf_dir: str, bad: bool = False) -> DataFrame:
    return select(spark, sf_dir, BAD_LINES if bad else LINES, "SELECT * FROM " + ("bad" if bad else "lines"))


def dets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(spark, sf_dir, DETS, "SELECT * FROM dets")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cls, id, emb)."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("label").alias("cls"), F.col("vec_id").alias("id"), F.col("embedding").alias("emb"))


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = vectors(spark, sf_dir).where("id % 5 = 0 AND cls <> 9")
    return own.select("cls", F.concat(F.lit("ref"), F.col("id")).alias("ref_name"), F.col("id").alias("ord"), "emb")


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).where("id % 5 <> 0")


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cls, ord, hash): 64 sign bits."""
    return vectors(spark, sf_dir).select("cls", F.col("id").alias("ord"), sign_bits(F.col("emb")).alias("hash"))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: the text of a class list, with blank lines."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    rows = nation.agg(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]).alias("n"))
    return rows.select(F.array_join("n", "\n\n ").alias("text"))
