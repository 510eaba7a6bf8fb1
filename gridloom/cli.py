"""Command line: ``python -m gridloom.cli evaluate|crops|export ...``; every parameter of the pipelines is an option."""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from dataclasses import fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import report
from gridloom.config import FUSE_A_INTERACTIVE, Evaluate, Extract, ExtractPlain, FuseA, FuseB
from gridloom.functions import boxes
from gridloom.operators import folds, joins, metrics
from gridloom.sources import images, labels, summary, writers

CONFIGS = {"fuse-a": FuseA(), "fuse-a-interactive": FUSE_A_INTERACTIVE, "fuse-b": FuseB(), "crops": Extract(), "crops-plain": ExtractPlain(), "evaluate": Evaluate()}


def add_options(parser: argparse.ArgumentParser, config) -> None:
    """An option for each field, with its default."""
    for f in fields(config):
        value = getattr(config, f.name)
        kind = {"type": lambda x: x.lower() in ("1", "true", "yes")} if isinstance(value, bool) else {"type": float, "nargs": "+"} if isinstance(value, tuple) else {"type": type(value)}
        parser.add_argument("--" + f.name.replace("_", "-"), default=value, **kind)


def config_of(args: argparse.Namespace, config):
    """The config with what the options say."""
    said = {f.name: getattr(args, f.name) for f in fields(config)}
    return replace(config, **{k: tuple(v) if isinstance(v, list) else v for k, v in said.items()})


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="gridloom")
    commands = out.add_subparsers(dest="command", required=True)
    for name, paths in (("evaluate", ("truths", "predictions", "classes")), ("crops", ("images", "labels", "out")), ("crops-plain", ("images", "labels", "out")), ("export", ("summary", "labels", "out")), ("parameters", ())):
        one = commands.add_parser(name)
        for path in paths:
            one.add_argument(f"--{path}", required=True)
        if name in CONFIGS:
            add_options(one, CONFIGS[name])
    for name in ("fuse-a", "fuse-a-interactive", "fuse-b"):
        one = commands.add_parser(name)
        for path in ("proposals", "bank", "out"):
            one.add_argument(f"--{path}", required=True)
        one.add_argument("--width", type=float, default=1.0)
        one.add_argument("--height", type=float, default=1.0)
        add_options(one, CONFIGS[name])
    return out


def _boxes(spark: SparkSession, folder: str, scored: bool) -> DataFrame:
    """(img, cls, ord, box): label files' boxes in units of the image, numbered by line; with a score of 1 if scored."""
    rows = labels.parse(labels.read_lines(spark, folder)).withColumnsRenamed({"stem": "img", "line_no": "ord"})
    corners = boxes.centre_to_corners(*(F.col(c) for c in ("cx", "cy", "w", "h")))
    own = [c.alias(n) for c, n in zip(corners, folds.BOX, strict=True)]
    return rows.select("img", "cls", "ord", *([F.lit(1.0).alias("score")] if scored else []), *own)


def evaluate(spark: SparkSession, args: argparse.Namespace, config: Evaluate) -> None:
    names = labels.class_names(spark.read.text(args.classes, wholetext=True).select(F.col("value").alias("text")))
    truths, preds = _boxes(spark, args.truths, False), _boxes(spark, args.predictions, True)
    hits = folds.greedy_hits(preds, truths, ["img", "cls"], sorted({config.iou, *config.coco}))
    rows = metrics.evaluate(preds, truths, hits, list(config.coco), config.iou)
    for line in report.lines(report.report_rows(rows, metrics.overall(rows), names)):
        print(line)
    stats = metrics.per_image_stats(folds.greedy_match(preds, truths, ["img", "cls"], [config.iou]), truths, ["img", "cls"])
    for line in report.image_lines(metrics.per_image_matrix(stats, [r.cls for r in names.select("cls").orderBy("cls").collect()])):  # classes are few
        print(line)


def crops(spark: SparkSession, args: argparse.Namespace, config) -> None:
    found = labels.stride(images.pixels(spark, args.images), config.stride)
    rows = labels.parse(labels.read_lines(spark, args.labels), strict=False)
    joined = rows.join(found.select("stem", "width", "height"), "stem")
    corners = boxes.centre_to_pixels(*(F.col(c) for c in ("cx", "cy", "w", "h", "width", "height")), config.padding)
    wanted = joined.select("stem", F.col("cls"), F.col("line_no").alias("idx"), *[c.alias(n) for c, n in zip(corners, folds.BOX, strict=True)])
    cut = images.crops(found, wanted)
    if getattr(config, "hash_distance", 0) > 0:
        cut = folds.hash_dedup(cut.withColumn("ord", F.struct("stem", "idx")), ["cls"], config.hash_distance).where("kept").drop("kept", "ord")
    writers.write_crops(cut, args.out)


def export(spark: SparkSession, args: argparse.Namespace) -> None:
    entries = summary.parse(spark.read.text(args.summary, wholetext=True).select(F.col("value").alias("json")))
    there = spark.read.option("pathGlobFilter", "*.txt").text(args.labels, wholetext=True).select(labels.file_path().alias("p"), F.col("value").alias("content"))
    # Label files are found by their names in the folder given.
    name = lambda c: F.regexp_extract(c, r"([^/]*)$", 1)
    entries = entries.withColumn("info", F.col("info").withField("label_file", name(F.col("info.label_file"))))
    print("%d copied, %d missing" % writers.export_labels(entries, there.select(name(F.col("p")).alias("path"), "content"), args.out))


def fuse(spark: SparkSession, args: argparse.Namespace, config) -> None:
    from gridloom import pipelines

    rows, bank = spark.read.parquet(args.proposals), spark.read.parquet(args.bank)
    kept, skipped = joins.with_bank(rows, bank)
    for r in skipped.toLocalIterator():
        print(f"class {r.cls} has no reference crops and is skipped")
    out = pipelines.fuse_a(kept, bank, args.width, args.height, config) if isinstance(config, FuseA) else pipelines.fuse_b(kept, bank, config)
    out.write.mode("overwrite").parquet(args.out)


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    if args.command == "parameters":
        for name, config in CONFIGS.items():
            print(name, config)
        return
    spark = spark or SparkSession.builder.appName("gridloom").getOrCreate()
    config = config_of(args, CONFIGS[args.command]) if args.command in CONFIGS else None
    if args.command == "evaluate":
        evaluate(spark, args, config)
    elif args.command.startswith("crops"):
        crops(spark, args, config)
    elif args.command == "export":
        export(spark, args)
    else:
        fuse(spark, args, config)


if __name__ == "__main__":
    main()
